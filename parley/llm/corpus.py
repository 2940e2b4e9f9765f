"""The labelled material of the sequence models: sentences with slots, slot words, and rules that make names and numbers.

Sentences and words are written for this module. Names, places and numbers are drawn by rule, so no list of real people
stands here; the given names are usual ones of many countries and serve as a feature too.
"""

from __future__ import annotations

import random
import re

# Usual given names.
GIVEN = """Aaron Abdul Adam Adriana Ahmed Aiko Alan Alberto Alejandra Alice Amir Amy Ana Andrea Andrei Angela Anil Anita Anna Antonio
Arthur Ayesha Barbara Beatrice Bogdan Brian Bruno Carla Carlos Carmen Caroline Catherine Chen Claire Claudia Craig Cristina Daisuke Dana
Daniel David Deepak Dennis Diana Diego Dmitri Donald Elena Emil Emily Emma Eric Erika Ethan Eva Felipe Felix Fernando Filip Francesca
Frank Gabriel George Gina Greta Hannah Harold Hassan Heather Heinz Helen Hiroshi Ian Ibrahim Igor Irina Isabel Ivan Jack Jacob Jakob James
Jan Jana Janet Jason Javier Jean Jessica Joan Johan John Jonas Jorge Jose Juan Judith Julia Julian Jun Karen Karin Karl Kofi Kumar Kyle
Lars Laura Lena Leo Leonardo Lin Linda Lisa Lucas Lucia Luis Magda Mahmoud Manuel Marco Margit Maria Mariam Marie Mario Mark Marta Martin
Mary Max Mei Mia Miguel Mila Mohammed Monica Nadia Nancy Naomi Natalia Neil Nicole Nikolai Nina Noah Nora Oscar Otto Pablo Paul Paula Pedro
Peter Petra Philip Pierre Rachel Raj Ralf Raquel Ravi Renata Ricardo Richard Rosa Ruth Ryan Sandra Sara Scott Sean Sofia Stefan Susan""".split()
# Words that begin sentences or join them, of English.
COMMON = set(
    """a about above across after again against all almost already also although always am among an and another any anybody anyone are around as
at be because been before behind being below beside between beyond both but by call can could dear despite did do does done down during each
either else even ever every everybody everyone few finally first for from give had has have he hello her here hers hi him his how however i if in
inside instead into is it its just keep last later least less let like many may maybe me meanwhile might more most much must my near neither never
next no nobody none nor not nothing now of off often ok okay on once one only onto or other our out over own per perhaps please put quite rather
really same see send several shall she should since so some somebody someone soon still such take than thank thanks that the their them then there
these they thing this those though through till to today together tomorrow too toward under unless until up upon us very was we well were what when
where whether which while who whom whose why will with within without would write yes yesterday yet you your""".split()
)
OPENERS = sorted(w for w in COMMON if len(w) > 1)
# Words for the slots of the sentences.
WORDS = {
    "a": "quiet|rusty|heavy|narrow|leaking|crowded|vintage|wooden|silent|laminated|cracked|portable|dusty|yellow|cheap|folding|left-hand|half-empty|noisy|soft|third|waterproof|upper|stolen".split("|"),
    "n": "kettle|bicycle|violin|ladder|blanket|umbrella|lantern|telescope|greenhouse|orchard|canteen|lift|projector|bakery|ferry|tram|fountain|library|curtain|engine|radiator|suitcase|freezer|trolley|tent|piano|fence|balcony|helmet|vaccine|syllabus|choir|bus-stop|tool-shed|coffee|museum|tenancy|printer|garage|sink".split("|"),
    "v": "paint|repair|borrow|rinse|polish|lend|fetch|water|plant|tune|iron|weigh|sew|bake|feed|carry|count|sweep|hang|unlock|photograph|replace".split("|"),
    "d": "painted|repaired|borrowed|rinsed|polished|fetched|tuned|weighed|baked|carried|swept|sold|unlocked|cleaned|lost|ready|gone|full".split("|"),
    "g": "the neighbours|the kitchen staff|our caretaker|the front desk|the parents|the night nurse|the drivers|reception|the coaches|the second floor|maintenance|the landlord|the treasurer|the book club|customs|the lifeguards|housing|the ferry office|the volunteers|our dentist".split("|"),
    "t": "after breakfast|at dusk|on the first of May|before the concert|during the holidays|tomorrow evening|in the afternoon|once the snow melts|last winter|by Sunday|any minute now|in March|twice a week|around midnight|on Thursday|from now on|in ten days|when school starts|at the weekend|straight away|for the time being".split("|"),
    "x": "a cordless drill|the blue folder|four folding chairs|a box of nails|the guest list|our winter tyres|some clean towels|the season ticket|a jar of honey|her spectacles|the gas meter|two spare batteries|the rent book|a bag of cement".split("|"),
}
#: Sentences; a brace is a slot: personal information in capitals, words by a letter, the rest by rule.
MARKED = """
You can reach {g} on {PHONE} {t}.
If the {n} leaks again dial {PHONE}.
Her new cell is {PHONE}, so update {x}.
{PHONE} is printed on the {n}.
Text {PHONE} for {code}.
The switchboard ({PHONE}) closes {t}.
Contact: {PHONE} or {EMAIL}
Fax {PHONE}
Mob. {PHONE}
Reception rang from {PHONE} about the {a} {n}.
Try {PHONE} first and then {PHONE}.
Nobody picks up at {PHONE} {t}.
Ask for the {n} desk at {PHONE} before you {v} it.
The {cap} helpline is now {PHONE}.
The {n} number changed to {PHONE} {t}.
Just ring back under {PHONE} when the {n} is {d}.
For {cap} you dial {PHONE}, for {cap} you knock.
Until the {n} is {d} use {PHONE} and ask {g}.
Mail {x} over to {EMAIL} {t}.
Her address is {EMAIL}, not the old one.
Forward this to {EMAIL} and to {g}.
Anything on the {n} belongs to {EMAIL}.
Sign up via {EMAIL} {t}.
{EMAIL} bounced when {g} wrote.
Put {EMAIL} in copy once the {n} is {d}.
I wrote {EMAIL} on the form for {cap}.
Questions? {EMAIL}
The {cap} list is run from {EMAIL}.
{NAME} ({EMAIL}) keeps {x}.
Invoices should reach {EMAIL}, {g} will {v} the rest.
Somebody at {EMAIL} wants to {v} the {n}.
Type {EMAIL} when the {n} asks for it {t}.
His passport, number {ID}, expires {t}.
Passport no. {ID} was found beside the {n}.
Write your tax number {ID} on {x}.
Tax ID: {ID}
The driver showed licence {ID} to {g}.
Licence number {ID} was {d} {t}.
Her identity card {ID} is still with {g}.
ID card no {ID}, issued in {cap}.
My social security number is {ID} and the {n} wants it.
SSN {ID} appears on {x}.
National insurance {ID} was read out aloud.
The insurance number {ID} goes with the {a} {n}.
We noted {ID} as the passport of the guest in {cap}.
Somebody scanned an identity card, {ID}, near the {n}.
Under tax reference {ID} the {n} was {d}.
Please blank out driving licence {ID} in {x}.
The {n} list has a tax identification, {ID}, in the open.
The party is at {ADDR}, bring {x}.
Our office sits at {ADDR}, {town} {zip}.
Pick up the {n} from {ADDR} {t}.
{G} moved to {ADDR} {t}.
Post the {n} to {ADDR} in {town}.
The plumber rings at {ADDR} first.
Take {x} to {ADDR}, {town}, before you {v} the {n}.
The tenant of {ADDR} wants the {n} {d}.
Address on file: {ADDR}, {town} {zip}.
There was smoke near {ADDR} {t}.
Number plates go to {ADDR} and {x} to {g}.
The {n} shop at {ADDR} is shut.
{ADDR} is on the {n} round {t}.
{NAME} signed for the {n}.
Yesterday {NAME} lost {x}.
Give {x} to {NAME} {t}.
Is {NAME} still in {cap}?
The {n} is owned by {NAME}, ask {g}.
I met {NAME} and {NAME} at the {n}.
We thank {NAME} for the {a} {n}.
An invoice from {NAME} is missing.
The letter names {NAME} as the owner of the {n}.
{NAME} and {g} {v} the {n} {t}.
Ask {NAME} whether the {n} in {cap} is {d}.
Did you know that {NAME} sold the {a} {n}?
A note for {NAME} lies on the {n}.
The hall was booked by {NAME} under {code}.
Patient {NAME} waits for the {n}.
No one but {NAME} may {v} it.
Even {NAME} could not {v} the {n} of {cap}.
As {NAME} said, {g} will {v} it.
Once more {NAME} paid for {x}.
Payment of {price} went to {NAME}.
Dear {NAME}, the {n} is {d}.
{NAME} wrote that the {n} costs {price}.
With {NAME} the {n} of {cap} was {d}.
If {g} agrees {NAME} gets {x}.
{NAME}, {g} and the {n} crew met {t}.
{NAME} {v}s the {n}, {NAME} does not.
{given} forgot {x}.
Maybe {given} can {v} the {n} {t}.
Hi {given}, the {n} is {d}.
{given} or {given} should {v} it.
Many thanks {given}.
{given} says {cap} is shut.
Good, {given}, then {v} it {t}.
So {given} and {given} {v} the {n}.
Parcel {order} arrived {t}.
Invoice {order} lists {num} chairs.
Receipt {order} was {d} under {code}.
The log of {date} is empty.
Photo {date} is blurred.
Release {ver} runs on {ip}.
Machine {ip} went down at {clock}.
Port {num} of {ip} is open.
We paid {price} for {num} tickets.
Roughly {num} percent of the seats were taken.
The bus leaves at {clock}, platform {num}.
Room {num} on floor {num} is free.
Case {code} was merged with {code}.
Serial {order} is {d} since {date}.
Between {clock} and {clock} the {n} is shut.
It weighs {num} kilos and costs {price}.
Page {num}, line {num}: the {n} is {a}.
The street market opens at {clock}.
Road works near gate {num} {t}.
Wait at the street corner by pier {num}.
Follow #{n} or @{n} for news.
The {n} holds {num} units, about {num} percent of the {n}.
{cap}, {cap} and {cap} share the {n}.
From {cap} to {cap} the {n} takes {num} minutes.
{cap} needs a {a} {n}, {cap} has one.
The {cap} {n} is {d}.
Next stop {cap}, then {cap}.
In {cap} {g} {v} every {n}.
We looked at {cap}, {code} and {cap}.
Both {cap} and {code} mention the {n}.
Unless {cap} opens {t} we need {x}.
Read {cap} for details, or {code}.
Part {code} fits {cap}, {cap}.
Compare {cap} with {cap}, {cap} and {code}.
{CAP} is the SAME as {cap}.
The North {n} and the South {n} are {d}.
Once {cap} was {d}, {g} left.
Soon {cap} gets a {n}, {cap} a {n}.
Still {cap} has no {n}.
Perhaps {cap} will {v} it {t}.
Everyone in {g} likes {cap}.
By the {n} guide {cap} shuts {t}.
For {cap} the {a} {n} was {d}.
{cap} to {cap}, sheet {code}, next to {cap}.
Could you {v} the {n} and then {v} {x}?
Who left the {a} {n} in {cap}?
We might {v} the {n} but {g} won't.
{G} found the {a} {n} {t}.
{G} took {x} to {cap}, which is {a}.
A {a} {n} is better than a {n} that {g} {v}.
I never {v} it because the {n} is {a}.
Whether the {n} is {d} depends on {g} and on {x}.
It is {a} and {d}, so nobody will {v} it.
{open} {cap} {v}s the {n} {t}.
{open} {cap} the {n} was {d}.
{open} {cap} and {cap} share {x}.
{open} {cap}, {cap} or {code} gets a {n}.
{open} {NAME} lost {x}.
{open} {NAME} and {cap} agree {g} will {v} it.
{open} {given} can {v} the {n} of {cap}.
{open} the {n} of {cap} {g} saw {x}.
{open} {PHONE} the {n} can be {d}.
Doors {num} and {num} close {t}, so drive slowly.
It is a long way, {num} miles, to the court of {cap}.
Place {num} of them on the square {n} and close {code}.
Drive {num} nails into it, close the {n} and lay {x} on the street.
A mobile like {PHONE} costs {g} {price}.
Their landline is {PHONE}, the telephone of {cap} is broken.
Telephone calls from {PHONE} reach {g} {t}.
The phone line {PHONE} crackles when the {n} is {d}.
We left word with {PHONE} and with {g}.
{cap} answers under {PHONE} until {clock}.
The bill for {NAME} came {t}.
{x} for {NAME}, {x} for {g}.
A quarrel between {NAME} and {g} was about the {n}.
They sent {NAME} home with {x}.
The words of {NAME} about {cap} were {a}.
Wait in {cap} with {NAME} until the {n} is {d}.
It was {d} by {NAME} {t}.
Letters by {NAME} arrive {t}.
Nothing in {cap} scares {NAME} more than the {n}.
Do {NAME} a favour and {v} the {n}.
Our thanks reach {NAME}, {NAME} and {g}.
{g} told {NAME} to {v} {x}.
{G} hired {NAME} {t}.
The lock at {ADDR} was {d} {t}.
We live at {ADDR} since the {n} was {d}.
Our bus stops by {ADDR}, near {cap}.
Write to {ADDR} or ring {PHONE}.
The {n} goes to {ADDR} {t}, the {n} to {cap}.
That flat, {ADDR}, has a {a} {n}.
Her record under {ID} names the {n} of {cap}.
The card with the digits {ID} opens the {n}.
Papers with {ID} in them were {d} by {g}.
The passport of {g} bears number {ID}.
Her passport has the number {ID}, his {ID}.
A tax paper, number {ID}, and {x} were {d}.
A licence, {ID}, and a passport, {ID}, lay on the {n}.
Ping {ip} and {ip} before the {n} is {d}.
The gateway at {ip} is slow {t}.
{ip} no longer replies to {ip}.
Ring {PHONE} now or {t}, it is {PHONE} at night.
{cap} can be had under {PHONE} now.
Messages for the {n} at {PHONE} were {d}.
My {n} went from {num} to {num} {t}.
They {v} {cap}, {cap} and the {n} with {given}, {given} and {given}.
We called in {NAME} before the {a} {n} was {d}.
Let in {NAME} and {v} {x}.
Call {PHONE} {t}.
Call {PHONE} and {PHONE} once {cap} is {d}.
Hotline: {PHONE}
Any message on {PHONE} is {d} {t}.
The {cap} hotline, {PHONE}, is {a}.
They believe in {NAME}, not in {cap}.
{NAME} keeps {x}.
You can rely on {NAME} {t}.
The talk was of {NAME} and of {cap}.
{G} checked in {NAME} {t}, then {NAME}.
A table near {NAME}, a {n} near {cap}.
We lent {NAME} {x}.
The {a} {n} cost {NAME} {price}.
Mention @{n} and @{v} on the {n}.
@{n}, it is {a}.
""".strip().splitlines()

_ON, _VOWELS = "b bl br c ch d dr f fl g gr h j k kl l m n p pr r s sch st t th tr v w z".split(), "a e i o u ai au ea ei ie oo ou".split()
_END = ["", "", "n", "r", "s", "l", "m", "t", "nd", "rt", "ck", "ng", "lf", "st", "x"]
_TAILS = "son sen berg mann ski ova ov ez ini elli ford ton ham field well wood ley er i o a".split()


def invented(r: random.Random, least: int = 2, most: int = 3) -> str:
    """A word of a few random syllables, capitalised."""
    return "".join(r.choice(_ON) + r.choice(_VOWELS) + r.choice(_END) for _ in range(r.randint(least, most))).capitalize()


def family(r: random.Random) -> str:
    """An invented surname; some have a usual ending, an accent, a hyphen or a particle."""
    out = invented(r, 1, 2) + (r.choice(_TAILS) if r.random() < 0.5 else "")
    k = r.random()
    if k < 0.06:
        at = r.randrange(1, len(out))
        out = out[:at] + r.choice("øéüåñöçłš") + out[at + 1 :]
    return f"{out}-{invented(r, 1, 2)}" if k > 0.97 else f"{r.choice(['de', 'van', 'van der', 'von', 'di', 'da', 'del', 'la'])} {out}" if k > 0.88 else out


def name(r: random.Random) -> str:
    """A full name in one of its usual forms: both orders, initials, titles, capitals."""
    first, last = r.choice(GIVEN) if r.random() < 0.6 else invented(r, 1, 3), family(r)
    title = r.choice(["Dr.", "Prof.", "Mr", "Mrs", "Ms", "Mr.", "Mrs.", "Dr"])
    form = r.choice([f"{first} {last}"] * 5 + [f"{last}, {first}"] * 4 + [f"{first[0]}. {last}"] * 3 + [f"{title} {last}"] * 4 + [f"{title} {first} {last}", f"{first} {r.choice(GIVEN)[0]}. {last}", f"{last}, {first[0]}."])
    if "," in form and first not in GIVEN:  # told from a list of places by the given name alone
        form = f"{last}, {r.choice(GIVEN)}"
    return form.upper() if r.random() < 0.08 and "." not in form else form


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def filled(r: random.Random, pattern: str) -> str:
    """A pattern with a digit for each 9 and a capital for each A."""
    return "".join(r.choice("0123456789") if c == "9" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in pattern)


def phone(r: random.Random) -> str:
    """A telephone number: a country, area or no prefix, and groups of two to five digits between like marks; or digits alone."""
    if r.random() < 0.25:
        return r.choice("2345679") + digits(r, 9) if r.random() < 0.75 else "0" + digits(r, r.choice([9, 10]))
    if r.random() < 0.2:
        return filled(r, r.choice(["999-999-9999", "(999) 999-9999", "999.999.9999", "+1 999 999 9999", "+1-999-999-9999", "+1.999.999.9999"]))
    sep = r.choice([" ", " ", " ", "-", "-", "."])
    groups = sep.join(digits(r, n) for n in r.choice([(3, 4), (4, 4), (4, 4), (2, 2, 2, 2), (2, 2, 2, 2), (3, 3, 3), (3, 3, 4), (4, 6), (5, 3), (2, 4, 4), (4, 3)]))
    area = digits(r, r.choice([1, 2, 2, 3, 3]))
    head = r.choice(["", f"+{digits(r, r.choice([1, 2, 2]))}{sep}", f"+{digits(r, 2)}{sep}{digits(r, r.choice([1, 2, 3]))}{sep}", f"00{digits(r, 2)}{sep}{area}{sep}", f"(0{area}) ", f"({area}) ", f"0{area}{sep}", f"+{digits(r, 2)} (0){digits(r, 2)} "])
    return head + groups if head else f"0{area}{sep}{groups}"


# Usual forms of numbers of passports, licences, cards, tax, insurance and social security records.
ID_FORMS = "A99999999|AA9999999|A9999999|AA999999A|AA 99 99 99 A|999-99-9999|999-99-9999|999 99 9999|99/999/99999|A9999999A|9999-9999-9999|9999 9999 9999|99 999 999 999|99999999A|AA999999|999.999.999-99".split("|")


def identity(r: random.Random) -> str:
    out = filled(r, r.choice(ID_FORMS))
    return r.choice("123456789") + out[1:] if out[0] == "0" else out


def email(r: random.Random) -> str:
    """An address: whole, masked or spelled out in words."""
    a, b = r.choice(GIVEN).lower(), re.sub("[^a-z]", "", family(r).lower()) or "x"
    local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{b}.{a[0]}", f"{a}_{b}{digits(r, 2)}", f"{a}+{r.choice(WORDS['n'])}", f"{b}{digits(r, 3)}", f"{b}-{a}", f"{a}.{b}{digits(r, 1)}", a, "info", "office"])
    host = invented(r, 2, 3).lower() + r.choice(["", "", "-" + invented(r, 1, 1).lower(), ".co"]) + r.choice([".com", ".org", ".net", ".de", ".uk", ".example", ".test", ".invalid"])
    form = r.random()
    if form < 0.55:
        return f"{local}@{host}".upper() if r.random() < 0.12 else f"{local}@{host}"
    if form < 0.7:
        return f"{local}{r.choice([' (at) ', ' [at] ', '(at)'])}{host}"
    if form < 0.84:
        return f"{local}[at]{host.replace('.', '[dot]')}" if r.random() < 0.6 else f"{local}(at){host.replace('.', '(dot)')}"
    for mark, word in ((".", "dot"), ("_", "underscore"), ("+", "plus"), ("-", "dash")):
        local = local.replace(mark, f" {word} ")
    return f"{local} at {host.replace('.', ' dot ')}"


def address(r: random.Random) -> str:
    """A street with a house number, in the order of one of several countries."""
    stem = invented(r, 1, 2)
    n = str(r.randrange(1, 400)) + r.choice(["", "", "", r.choice("abc")])
    form = r.random()
    if form < 0.4:
        return f"{n} {r.choice(['', '', '', 'North ', 'East ', 'Old '])}{stem} {r.choice(['Street', 'Lane', 'Rd.', 'Road', 'Ave', 'Avenue', 'Close', 'Boulevard', 'Drive', 'Court', 'Way', 'St', 'Place'])}"
    if form < 0.68:
        return f"{stem}{r.choice(['strasse', 'straße', 'str.', 'str.', 'str.', 'weg', 'weg', 'gasse', 'allee', 'platz'])} {n}"
    return r.choice([f"Calle {stem} {n}", f"Calle {stem}, {n}", f"Via {stem} {n}", f"{n}, rue {stem}", f"{n} rue {stem}", f"{n}, rue de {stem}", f"{n}, avenue {stem}"])


def clock(r: random.Random) -> str:
    return f"{r.randrange(24)}:{r.randrange(60):02d}"


def label(r: random.Random, known: float) -> tuple[str, str]:
    """A time mark, which may be empty, and a speaker's label; `known` is the share of usual given names."""
    first, last = r.choice(GIVEN) if r.random() < known else invented(r, 1, 3), family(r)
    who = r.choice([f"{first} {last}", first, f"{first} {last[0]}.", f"SPEAKER_0{r.randrange(9)}", f"Speaker {r.randrange(9)}", f"{first} {last}"])
    who = who.upper() if r.random() < 0.25 else who
    form = r.choice(["**{}:**", "[{}]:", "({})", ">> {}:", "{} -", "{}:", "**{}**:", "{}:", "({})"]).format(who)
    return (stamp(r) if r.random() < 0.55 else "", form)


def stamp(r: random.Random) -> str:
    """A time mark as subtitles and recorders write them."""
    h, m, s, ms = digits(r, 2), digits(r, 2), digits(r, 2), digits(r, 3)
    return r.choice([f"[{m}:{s}]", f"({m}:{s})", f"[{h}:{m}:{s}]", f"<{h}:{m}:{s}.{ms}>", f"{h}:{m}:{s}", f"[{m}:{s} - {m}:{s}]", f"[{digits(r, 1)}:{s}]", f"{h}:{m}:{s},{ms} --> {h}:{m}:{s},{ms}"])


def slot(r: random.Random, kind: str) -> str:
    """A filling of a slot that is no personal information."""
    if kind in WORDS:
        return r.choice(WORDS[kind])
    if kind == "G":
        t = r.choice(WORDS["g"])
        return t[0].upper() + t[1:]
    make = {
        "cap": lambda: invented(r), "open": lambda: r.choice(OPENERS).capitalize(), "CAP": lambda: invented(r).upper(), "town": lambda: invented(r), "given": lambda: r.choice(GIVEN), "zip": lambda: digits(r, 5),
        "code": lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.choice([1, 2, 3, 3]))) + r.choice(["-", "-", "-", "", "#"]) + digits(r, r.choice([3, 4, 5])),
        "order": lambda: r.choice([f"{digits(r, 4)}-{digits(r, 5)}-{digits(r, 2)}", f"{digits(r, 5)}-{digits(r, 3)}", f"{digits(r, 4)}-{digits(r, 4)}-{digits(r, 1)}"]),
        "date": lambda: f"20{digits(r, 2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)),
        "ver": lambda: ".".join(digits(r, r.choice([1, 2])) for _ in range(3)), "clock": lambda: clock(r), "num": lambda: str(r.randrange(1, 10 ** r.choice([1, 2, 3]))),
        "price": lambda: r.choice(["$", "€", "£"]) + f"{r.randrange(1, 100)},{digits(r, 3)}",
    }
    return make[kind]()
