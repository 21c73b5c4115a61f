"""Personal information in free text: where it is, and text with typed placeholders instead.

Cheap marks (an at sign, a label, a street word, a phrase that introduces a person) are found in one pass by an
Aho-Corasick automaton; grammars for addresses, names, numbers and e-mails are only tried around those marks, so that
most of a text is scanned once. Whole texts are read, and no find is bounded by a number of characters. A full name that
is introduced once is found wherever else it stands in that text; common given names need no introduction. Overlaps go
to the longer find, then to the earlier one.

A placeholder names its type and holds a pseudonym: numbers and birth dates are permuted by a keyed Feistel network within
their format, so that equal values get equal pseudonyms in all documents and nobody without the key can undo it. Layout,
country codes and prefixes stay; a value that passes the checks of its kind (check letters and digits of DNI, NIE, NIR,
IBAN and tax numbers, the ranges of social security numbers, the calendar) gets one that passes them too. Other values
get a keyed tag.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UP, LOW = "A-ZÀ-ÖØ-ÞŁŚŠŽĆČ", "a-zà-öø-ÿłśšžćčığş"
CORE = rf"[{UP}][{UP}{LOW}'’]*[{UP}{LOW}](?:-[{UP}][{UP}{LOW}'’]*)*"
INIT = rf"[{UP}]\."
PART = r"(?:(?:van der|van den|van de|von der|von dem|de la|de las|de los|de l'|van|von|vom|de|del|della|di|da|das|dos|du|des|le|la|ter|ten|bin|ibn|ben|al|el|zu|zur|y|e|af|av|VAN DER|VON DER|DE LA|VAN|VON|DE|DEL|DI|DA|DOS|DU|LE|LA|TER|AL|EL) )"
GIVEN = rf"(?:{CORE}|{INIT}(?: ?{INIT})*)"
FULL = re.compile(rf"{GIVEN}(?: {INIT})* {PART}*{CORE}")
TURNED = re.compile(rf"{PART}*{CORE}, {GIVEN}(?: {INIT})*(?![{LOW}])")
SURNAME = re.compile(rf"{PART}*{CORE}")
#: fixed values: forms of address before a name, which are not part of it
TITLE = re.compile(r"(?:(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Sir|Herrn?|Frau|Sra|Sr|Srta|Doña|Don|Dra|Mme|Mlle|Monsieur|Madame|Señora?|Ing|Mag|Dipl)\.? )+")
FRENCH = re.compile(r"(?:\b(?:est|pour|par|à|chez|avec|contactez|selon|merci|écrivez) )$", re.I)
NOT_NAMES = frozenset(
    """ping contactez contact escriba rückfragen reach call thanks reported signed visit fixture old test gemeldet informado signalé responsable ansprechpartner ansprechpartnerin escalations her his their return install
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    the this that these those we you they it he she please see use version build request ticket uid note notes design runbook release readme todo fixme http https api sql json yaml html css url id ids""".split()
)
#: phrases that introduce a person, lower case; the name follows at once
BEFORE_NAME = (
    "reported-by: ", "signed-off-by: ", "reviewed-by: ", "acked-by: ", "co-authored-by: ", "tested-by: ", "suggested-by: ", "helped-by: ", "author: ", "authored by ", "committed by ", "commit by ", "cc ", "cc: ", "cc @", "ping ", "according to ", "thanks to ",
    "thank you, ", "spoke to ", "spoke with ", "talked to ", "talked with ", "met with ", " go to ", "this week: ", "on-call: ", "on call: ", "ask for ", "asked ", "ships to ", "sent to ", "todo(", "fixme(", "xxx(", "hack(", "contact: ", "contact ", "footer: ", "record: ",
    "row: ", "user_name=", "username=", "name=", "name: ", "\"user\": \"", "\"name\": \"", "\"author\": \"", "\"owner\": \"", "\"full_name\": \"", "\"contact\": \"", "'user': '", "'name': '", "owner: ", "maintainer: ", "assignee: ", "assigned to ", "belongs to ", "approved by ",
    "reviewed by ", "reported by ", "written by ", "filed by ", "raised by ", "from: ", "to: ", "dear ", "regards, ", "signed: ", "attn: ", "attn ", "c/o ", "call ", "email ", "write to ", "reach ",
    "signalé par ", "contactez ", "envoyé à ", "envoyée à ", "écrivez à ", "merci à ", "selon ", "d'après ", "demandez ", "appelez ", "auteur : ", "rédigé par ", "relu par ", "bonjour ",
    "gemeldet von ", "rückfragen an ", "geht an ", "danke an ", "laut ", "fragen sie ", "wenden sie sich an ", "autor: ", "erstellt von ", "geprüft von ", "hallo ", "ansprechpartner: ", "ansprechpartnerin: ",
    "escriba a ", "informado por ", "envía a ", "enviado a ", "gracias a ", "según ", "pregunte por ", "llame a ", "revisado por ", "escrito por ", "hola ", "contacte con ",
)
#: the same with one or two words between
ROLE_OF = re.compile(r"(?:responsable (?:du|de la|de l'|des) ?\w+ (?:est|:)|ansprechpartner(?:in)? für (?:den|die|das) \w+ ist|responsable (?:del|de la) \w+:|(?:owner|lead|contact) (?:of|for) the \w+ (?:is|:)|verantwortlich für (?:den|die|das) \w+ ist) ", re.I)
ROLE_MARKS = ("responsable d", "ansprechpartner", "owner of", "owner for", "lead of", "lead for", "contact for", "verantwortlich für")
AFTER_NAME = (" wrote:", " wrote ", " writes:", " said:", " schrieb:", " schreibt:", " a écrit", " escribió:", " replied:", " commented:")

#: fixed values: mailboxes of desks, services and machines
DESKS = frozenset(
    """support info admin administrator root git svn hg noreply no-reply donotreply do-not-reply postmaster webmaster hostmaster abuse security help helpdesk desk team office contact sales billing ops devops oncall on-call bot ci cd build builds
    deploy jenkins github gitlab dependabot renovate mailer mailer-daemon daemon nobody service services system alerts alert monitoring notifications notification notify news newsletter press jobs hr legal privacy dev developers api user users
    name example test tests feedback hello it accounts account orders order cron backup www ftp mail db database postgres mysql redis runner robot automation release releases""".split()
)
MAIL = re.compile(r"[A-Za-z0-9_](?:[\w.+'%-]*[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-]|\.\w)")
_HOST = r"[A-Za-z0-9][\w-]*"
_USER = r"(?<![\w.+-])[A-Za-z0-9_](?:[\w.+-]*[\w+-])?"
_DOT = r" ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|(?<= )dot(?= )|\(\.\)|\[\.\]|_dot_|\(punkt\)|\(point\)|\(punto\)) ?"
#: disguised addresses: with a marked at sign, whose dots may be plain, and with both spelled out
MARKED_MAIL = re.compile(rf"{_USER} ?(?:\(at\)|\[at\]|\{{at\}}|<at>|\(@\)|\[@\]|_at_) ?{_HOST}(?:(?:\.|{_DOT}){_HOST})+", re.I)
SPOKEN_MAIL = re.compile(rf"{_USER} at {_HOST}(?:{_DOT}{_HOST})+", re.I)
SEP = r"[ .\-/ ]"
PHONE = re.compile(
    rf"""(?<![\w.+\-/:#@])(?:
      (?:\+?1{SEP}?)?\(\d{{3}}\){SEP}?\d{{3}}{SEP}\d{{4}}
    | \+\d{{1,3}}(?:{SEP}?\(0\))?(?:{SEP}?\(?\d{{1,5}}\)?){{2,6}}
    | (?:1{SEP})?\d{{3}}(?P<s>[ .\-])\d{{3}}(?P=s)\d{{4}}
    | 00\d{{2}}{SEP}\d{{1,4}}(?:{SEP}\d{{2,8}}){{1,4}}
    | \(0\d{{1,5}}\){SEP}?\d{{2,8}}(?:{SEP}\d{{2,6}}){{0,4}}
    | 0\d{{2,5}}[ /\-]\d{{3,8}}(?:[ \-]\d{{2,6}}){{0,3}}
    | 0[1-9](?:{SEP}\d{{2}}){{4}}
    | [679]\d{{2}}[ ]\d{{3}}[ ]\d{{3}} | [679]\d{{2}}(?:[ ]\d{{2}}){{3}}
    )(?![\w@]|[.\-/]\d|:\d)""",
    re.X,
)
PHONE_MARK = re.compile(r"[+(0-9][0-9(]")
NOT_PHONE = re.compile(r"(?:ticket|port|ports|pair|request|anfrage|requête|petición|version|build|issue|rfc|ip|isbn|uid|digest|hash|commit|rev|line|lines|pr|bug|order no\.?|invoice no\.?|id)[ :#]*$", re.I)
LABELS = (
    "ssn", "social security", "nino", "ni number", "national insurance", "nir ", "sécurité sociale", "securite sociale", "dni", "nie ", "nie:", "documento", "cédula", "nif", "pasaporte", "passeport", "steuer-id", "steuer id", "steueridentifikationsnummer", "steuernummer", "idnr", "ausweis",
    "reisepass", "passport", "travel document", "identity card", "id card", "id number", "identity number", "driver", "licence no", "license no", "carte d'identité", "tax id", "taxpayer", "personalausweis", "sozialversicherung", "codice fiscale", "curp", "iban", "national id",
)
LINK = r"(?:\s*(?:numbers?|nummer|numéro|número|núm\.?|nr\.?|no\.?|n°|nº|#|id|card|permit|is|lautet|ist|est|es|code)){0,3}\s*[:=#]?\s*"
LABEL = re.compile(rf"(?:{'|'.join(re.escape(x.strip().rstrip(':')) for x in sorted(LABELS, key=len, reverse=True))})(?:ummer|nummer|snummer)?{LINK}", re.I)
ID_VALUE = re.compile(
    r"""(?:[12][ .]?\d{2}[ .]?\d{2}[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}(?:[ .]?\d{2})? | [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D] | \d{3}[ \-]\d{2}[ \-]\d{4} | [XYZ][ \-.]?\d{7}[ \-.]?[A-Z] | \d{2}\.?\d{3}\.?\d{3}[ \-]?[A-Z]
    | \d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3} | [A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})? | [A-Z]{1,3}[ \-]?\d{6,9}[A-Z]? | [A-Z]\d{2,3}[A-Z]\d{3,5} | [A-Z0-9]{9,12}(?<=\d) | \d{9,13} | \d{8}[ \-]?[A-Z])(?![\w]|-\d)""",
    re.X,
)
BARE_ID = re.compile(r"(?<![\w.\-/:#])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[12] \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3} \d{2})(?![\w]|-\d|\.\d)")
OWNER = re.compile(r"(?:,? (?:of|for|von|pour|de|del|belonging to|registered to|issued to|held by)|:|;|,) ")

BEGINS = re.compile(rf"(?<![\w'’.\-])(?={GIVEN}|{PART})")
PARTICLES = frozenset("van der den de von dem la las los vom del della di da das dos du des le ter ten bin ibn ben al el zu zur y e af av".split())
HEADS = re.compile(r"(?<![\w.\-])\w")
BEFORE_MAIL = re.compile(r"(?:\s*[<(\[]|;|\s*\|\s*(?:[^|\n]{1,30}\|\s*)?|,\s*(?:correo|joignable via|erreichbar über|reachable at|e-?mail:?)\s*|\",\s*\"(?:e?-?mail)\":\s*\")(?:mailto:)?$")
WORDS = rf"(?:[{UP}][{UP}{LOW}'’.\-]*[{UP}{LOW}'’\-])"
TOWN = rf"{WORDS}(?:[ \-](?:(?:am|an der|im|bei|sur|sous|en|la|le|les|de|del|upon|on)[ \-])?{WORDS}){{0,2}}"
ZIP = r"(?:[A-Z]{1,2}-)?\d{4,6}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
FLAT = r"(?:Unit|Flat|Apt|Apartment|Suite|Ste|Room|Floor|Office|House)\.? ?#?\d+[A-Za-z]?"
KIND = r"(?:Avenue|Ave|Street|St|Lane|Ln|Road|Rd|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Boulevard|Blvd|Terrace|Crescent|Square|Sq|Parkway|Pkwy|Highway|Hwy|Row|Gardens|Grove|Hill|Mews|Walk|Circle|Trail|Quay)"
GAP = r"(?:, ?\n?|\n| - )\s?"
ADDRESSES = (
    rf"(?:{FLAT},? )?\d{{1,5}}[A-Za-z]?,? (?:(?:North|South|East|West|N|S|E|W)\.? )?{WORDS}(?: {WORDS}){{0,2}} {KIND}\b\.?(?:,? {FLAT})?{GAP}{TOWN}(?:,? [A-Z]{{2}}(?= \d{{5}}))?(?:,? (?:{ZIP}))?",
    rf"(?:P\.? ?O\.? ?Box|Postfach|B\.?P\.?|Apartado(?: de correos)?) \d+{GAP}(?:(?:{ZIP}) {TOWN}|{TOWN}(?:,? (?:{ZIP}))?)",
    rf"\d{{1,5}}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours|square|passage|faubourg|voie)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?{WORDS}(?:[ \-]{WORDS}){{0,2}}{GAP}(?:(?:{ZIP}) {TOWN}|{TOWN}(?:,? (?:{ZIP}))?)",
    rf"(?:(?:Am|An der|An den|Im|Zum|Zur|Auf dem|Unter den|In der) )?[{UP}][{LOW}{UP}\-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|markt|hof|steig|chaussee)(?: (?:{WORDS} )?)?\s?\d{{1,4}}[ ]?[a-z]?(?:{GAP}(?:(?:{ZIP}) {TOWN}))",
    rf"(?:[{UP}][{LOW}]+ )(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer) \d{{1,4}}[ ]?[a-z]?{GAP}(?:{ZIP}) {TOWN}",
    rf"(?:Calle|C/|Avda\.?|Av\.|Avenida|Plaza|Pza\.|Paseo|Pº|Camino|Ronda|Travesía|Carretera|Vía)(?: de(?: la| los| las)?| del)? {WORDS}(?: {WORDS}){{0,2}},? (?:n\.?º ?)?(?:\d{{1,4}}[A-Za-z]?|s/n)(?:, ?\d{{1,2}}\.?[ºª°]?(?: ?[A-Z]\b| ?(?:izq|dcha)\.?)?)?{GAP}(?:(?:{ZIP}) {TOWN}|{TOWN}(?:,? (?:{ZIP}))?)",
)
ADDRESS = re.compile("|".join(f"(?:{a})" for a in ADDRESSES))
STREETS = (
    " Avenue", " Ave", " Street", " St.", " St,", " St\n", " Lane", " Ln", " Road", " Rd", " Close", " Drive", " Court", " Way,", " Way\n", " Place", " Boulevard", " Blvd", " Terrace", " Crescent", " Square", " Parkway", " Gardens", " Grove", " Hill,", " Mews", " Walk,", " Row,",
    "O. Box ", "O Box ", "PO Box", "Postfach ", "Apartado ", "rue ", "avenue ", "chemin ", "boulevard ", "place ", "allée ", "impasse ", "quai ", "route ", "straße", "strasse", "str. ", "weg ", "platz ", "allee ", "gasse ", "ring ", "damm ", "ufer ", "Straße", "Calle ", "C/ ", "Avda", "Avenida ",
    "Plaza ", "Paseo ", "Camino ", "Ronda ", "Carretera ",
)
#: fixed values: common given names that are no everyday words, English, German, French and Spanish
GIVEN_NAMES = (
    "Aaron", "Adam", "Adriana", "Alan", "Albert", "Alejandro", "Alexander", "Alexandra", "Alice", "Alicia", "Amanda", "Amélie", "Ana", "Andrea", "Andreas", "Andrew", "Angela", "Anna", "Anne", "Anthony", "Antoine", "Antonio", "Barbara", "Beatriz",
    "Benjamin", "Benoît", "Birgit", "Brian", "Camille", "Carlos", "Carmen", "Caroline", "Catherine", "Cécile", "Charles", "Charlotte", "Chloé", "Christian", "Christine", "Christophe", "Christopher", "Claire", "Claudia", "Cristina", "Daniel", "Daniela",
    "David", "Deborah", "Diego", "Dieter", "Dominique", "Donald", "Dorothy", "Edward", "Eduardo", "Elena", "Elizabeth", "Emily", "Emma", "Enrique", "Eric", "Esther", "Eva", "Felix", "Fernando", "Florian", "Francisco", "François", "Françoise", "Friedrich",
    "Gabriel", "Georg", "George", "Gérard", "Gerhard", "Gloria", "Guillaume", "Günter", "Hannah", "Hans", "Heike", "Helen", "Helmut", "Hélène", "Henry", "Ignacio", "Ingrid", "Isabel", "Isabelle", "Jacques", "James", "Jane", "Javier", "Jean", "Jennifer",
    "Jessica", "Joachim", "Johannes", "John", "José", "Joseph", "Juan", "Julia", "Julien", "Jürgen", "Karen", "Karl", "Karin", "Katharina", "Kathleen", "Kenneth", "Kevin", "Klaus", "Laura", "Laurent", "Linda", "Lisa", "Lorena", "Louis", "Luis", "Manuel",
    "Margaret", "María", "Maria", "Marie", "Mario", "Martin", "Mary", "Matthew", "Michael", "Michelle", "Miguel", "Monika", "Nancy", "Nathalie", "Nicolas", "Nicole", "Olivier", "Pablo", "Patricia", "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre",
    "Ralf", "Raquel", "Rebecca", "Richard", "Robert", "Ronald", "Sabine", "Samuel", "Sandra", "Sarah", "Sebastian", "Sergio", "Silvia", "Sophie", "Stefan", "Stephanie", "Steven", "Susan", "Susanne", "Sylvie", "Teresa", "Thierry", "Thomas", "Timothy", "Ursula",
    "Valérie", "Verónica", "Virginie", "Walter", "William", "Wolfgang", "Xavier", "Yves", "Zoé",
)
#: words that follow a given name in the name of a thing
THINGS = frozenset("api app build bridge cache class cluster server service framework library project protocol release repo repository road street square tool university institute".split())
BIRTH = re.compile(
    r"(?:\bborn(?: on)?|\bdate of birth|\bbirth date|\bbirthday|\bdob|\bgeboren am|\bgeburtsdatum|\bgeb\.|\bnée? le|\bdate de naissance|\bnacid[oa] el|\bfecha de nacimiento)\s*[:=]?\s*(?P<d>\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)", re.I
)
_built: dict[str, object] = {}


def _automata():
    if not _built:
        import ahocorasick

        low, exact = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, phrases in (("name", BEFORE_NAME), ("role", ROLE_MARKS), ("wrote", AFTER_NAME), ("id", LABELS), ("mail", ("@", "(at)", "[at]", "{at}", " at ", "_at_", "<at>"))):
            for p in phrases:
                low.add_word(p, (kind, len(p)))
        for p in STREETS:
            exact.add_word(p, ("street", len(p)))
        for p in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Herrn", "Frau", "Sra", "Sr", "Mme", "Mlle", "M", "Doña", "Don", "Dra", "Srta", "Monsieur", "Madame", "Señor", "Señora"):
            for stop in (" ", ". "):
                if (p, stop) not in (("M", " "), ("Don", ". ")):
                    exact.add_word(p + stop, ("title", len(p + stop)))
        for p in GIVEN_NAMES:
            exact.add_word(p + " ", ("given", len(p) + 1))
        low.make_automaton()
        exact.make_automaton()
        _built["low"], _built["exact"] = low, exact
    return _built["low"], _built["exact"]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_name(value: str) -> bool:
    words = re.findall(rf"[{UP}{LOW}'’]+", value)
    shouted = len(words) > 1 and all(w.isupper() for w in words if len(w) > 2) and len(words[0]) > 2  # all of the text is in capitals
    return not shouted and all(w.lower() not in NOT_NAMES for w in words) and any(len(w) > 2 for w in words)


def _monsieur(text: str, start: int, surname: str, end: int) -> bool:
    """Whether the ``M. `` before a surname means Monsieur and is no initial."""
    near = re.search(r"([\w.+-]+) ?(?:@|\(at\)|\[at\]| at )", text[end : end + 60], re.I)
    if near and near.start() < 45:
        local, plain = near[1].lower(), re.sub(r"[^a-z]", "", surname.lower())
        bare = re.sub(r"[^a-z]", "", local.split("+")[0])
        if plain and plain in bare:
            return not bare.startswith("m" + plain[:3]) and not bare.endswith(plain + "m") and not bare.replace(plain, "", 1).startswith("m")
        return not local.startswith("m")
    return bool(FRENCH.search(text[max(0, start - 14) : start])) or bool(re.search(r"\b(?:le|les|des|est|une|pour|dans|sans)\b.*\b(?:le|la|les|des|est|une|pour|dans|du)\b", text[max(0, start - 160) : end + 160]))


def name_at(text: str, at: int) -> tuple[int, int] | None:
    """The span of the name that begins at ``at``, after forms of address."""
    titled = TITLE.match(text, at)
    if titled:
        m = SURNAME.match(text, titled.end())
        return (titled.end(), m.end()) if m and _is_name(m[0]) else None
    if text.startswith("M. ", at) and (s := SURNAME.match(text, at + 3)) and _is_name(s[0]) and _monsieur(text, at, s[0], s.end()):
        return at + 3, s.end()
    m = FULL.match(text, at)
    if m and _is_name(m[0]):
        return m.span()
    m = TURNED.match(text, at)
    if m and _is_name(m[0]):
        return m.span()
    return None


def _back(text: str, at: int, floor: int) -> int:
    """Where the run of words that may belong to a name ending at ``at`` begins, one word more, not before ``floor``."""
    pos = at
    while pos > floor:
        j = text.rfind(" ", floor, pos)
        word = text[j + 1 if j >= 0 else floor : pos]
        if j < 0:
            return floor
        if not (word[:1].isupper() or word.rstrip(",") in PARTICLES):
            return j + 1
        pos = j
    return floor


def _name_ending(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The longest name that ends at ``at``."""
    lo = _back(text, at, floor)
    for m in BEGINS.finditer(text, lo, at):
        s = name_at(text, m.start())
        if s and s[1] == at:
            return s
        t = TITLE.match(text, m.start())
        if t and (v := SURNAME.match(text, t.end())) and v.end() == at:
            return v.start(), at
    return None


def _mails(text: str, at: int) -> tuple[int, int] | None:
    lo = at
    while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.+'%-"):
        lo -= 1
    while lo < at and not (text[lo].isascii() and (text[lo].isalnum() or text[lo] == "_")):
        lo += 1
    m = MAIL.match(text, lo)
    if not m or not m.start() < at < m.end():
        return None
    local = re.sub(r"\+.*", "", m[0].split("@")[0]).lower()
    if local in DESKS or local.rstrip("0123456789") in DESKS or re.search(r"(?:^|[-_.])(?:bot|noreply|no-reply|daemon|ci)$", local):
        return None
    before, after = text[max(0, m.start() - 12) : m.start()], text[m.end() : m.end() + 2]
    if before.endswith(("://", "/")) or re.match(r":[\w/]", after) or before.endswith("@"):
        return None
    return m.span()


def _disguised(text: str, at: int, size: int) -> tuple[int, int] | None:
    lo = at - 1 if at and text[at] not in " _" and text[at - 1] == " " else at
    while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.+-"):
        lo -= 1
    m = (SPOKEN_MAIL if text[at] == " " else MARKED_MAIL).match(text, lo)
    if not m or not m.start() <= at < m.end():
        return None
    local = re.split(r" ?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\]| at |_at_)", m[0], maxsplit=1, flags=re.I)[0].lower()
    return None if re.sub(r"\+.*", "", local) in DESKS else m.span()


def _address(text: str, end: int, floor: int) -> tuple[int, int] | None:
    """The address whose street mark ends at ``end``: at most eight words of it stand before the mark."""
    lo = end
    for _ in range(8):
        while lo > floor and not text[lo - 1].isspace():
            lo -= 1
        if lo <= floor:
            break
        while lo > floor and text[lo - 1].isspace():
            lo -= 1
    while lo > floor and not text[lo - 1].isspace():
        lo -= 1
    for p in HEADS.finditer(text, lo, end + 1):
        m = ADDRESS.match(text, p.start())
        if m and m.end() > end:
            return m.span()
    return None


def _disjoint(spans: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans in order of place, of those that overlap the longer one, then the earlier one."""
    taken: list[tuple[int, int, str]] = []
    for x in sorted(spans, key=lambda x: (-(x[1] - x[0]), x[0], x[2])):
        k = bisect_left(taken, x)
        if (k == 0 or taken[k - 1][1] <= x[0]) and (k == len(taken) or taken[k][0] >= x[1]):
            insort(taken, x)
    return taken


def _again(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further places of the full names among ``spans``."""
    import ahocorasick

    full = {text[s:e] for s, e, kind in spans if kind == "name" and " " in text[s:e]}
    full = {x for x in full if re.match(rf"[{UP}][{LOW}'’\-]", x) and ", " not in x}
    if not full:
        return []
    a = ahocorasick.Automaton()
    for x in full:
        a.add_word(x, len(x))
    a.make_automaton()
    out = []
    for end, size in a.iter(text):
        at = end - size + 1
        if not (at and (text[at - 1].isalnum() or text[at - 1] in "_.-/@'’")) and not re.match(r"[\w@]|[-.'’]\w", text[end + 1 : end + 3]):
            out.append((at, end + 1, "name"))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all personal information in a text, in order of place, without overlaps."""
    low, exact = _automata()
    small = _lower(text)
    spans: list[tuple[int, int, str]] = []
    ids: list[tuple[int, int]] = []
    for end, (kind, size) in low.iter(small):
        at = end - size + 1
        if kind == "name":
            before = small[at - 1] if at else " "
            if before.isalnum() and small[at].isalnum():
                continue
            if s := name_at(text, end + 1):
                spans.append((*s, "name"))
        elif kind == "mail":
            if s := _mails(text, at) if small[at] == "@" else _disguised(text, at, size):
                spans.append((*s, "email"))
        elif kind == "id":
            if at and (small[at - 1].isalnum() or small[at - 1] == "_"):
                continue
            m = LABEL.match(text, at)
            if m and (v := ID_VALUE.match(text, m.end())) and sum(c.isdigit() for c in v[0]) >= 5:
                ids.append(v.span())
        elif kind == "role":
            if (m := ROLE_OF.match(text, at)) and (s := name_at(text, m.end())):
                spans.append((*s, "name"))
        elif kind == "wrote":
            quoted = text.rfind("> ", text.rfind("\n", 0, at) + 1, at)
            if s := _name_ending(text, at, quoted + 2 if quoted >= 0 else text.rfind("\n", 0, at) + 1):
                spans.append((*s, "name"))
    reached = 0
    for end, (kind, size) in exact.iter(text):
        at = end - size + 1
        if kind == "title":
            if at and (text[at - 1].isalnum() or text[at - 1] in "._"):
                continue
            if s := name_at(text, at):
                spans.append((*s, "name"))
        elif kind == "given":
            if at and (text[at - 1].isalnum() or text[at - 1] in "_'’.-/@"):
                continue
            m = FULL.match(text, at)
            if m and _is_name(m[0]) and m[0].split()[-1].lower() not in THINGS:
                spans.append((*m.span(), "name"))
        elif end >= reached and (s := _address(text, end, reached)):
            spans.append((*s, "address"))
            reached = s[1]
    for m in BARE_ID.finditer(text):
        ids.append(m.span())
    for s in set(ids):
        spans.append((*s, "id_number"))
        if o := OWNER.match(text, s[1]):
            if v := name_at(text, o.end()):
                spans.append((*v, "name"))
    if PHONE_MARK.search(text):
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 8 <= digits <= 15 and not NOT_PHONE.search(text[max(0, m.start() - 14) : m.start()]):
                spans.append((m.start(), m.end(), "phone"))
    # a name before an address of a person: in brackets, after a bar or a comma
    for s, _, kind in [x for x in spans if x[2] == "email"]:
        line = text.rfind("\n", 0, s) + 1
        # the cue itself is short
        if cue := BEFORE_MAIL.search(text[max(line, s - 90) : s]):
            if v := _name_ending(text, max(line, s - 90) + cue.start(), line):
                spans.append((*v, "name"))
    return _disjoint({*spans, *_again(text, spans)})


# ---------------------------------------------------------------- pseudonyms
def feistel(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 10) -> int:
    """A keyed permutation of 0 .. size-1: a Feistel network on a slightly larger square, walked until inside."""
    side = math.isqrt(max(0, size - 1)) + 1

    def once(v: int) -> int:
        left, right = divmod(v, side)
        for r in range(rounds):
            mixed = hashlib.blake2b(b"%d|%d|%d|" % (r, right, size) + tweak, key=key[:64], digest_size=16).digest()
            left, right = right, (left + int.from_bytes(mixed, "big")) % side
        return left * side + right

    value = once(value)
    while value >= size:
        value = once(value)
    return value


def unfeistel(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 10) -> int:
    """The inverse of ``feistel``."""
    side = math.isqrt(max(0, size - 1)) + 1

    def once(v: int) -> int:
        left, right = divmod(v, side)
        for r in reversed(range(rounds)):
            mixed = hashlib.blake2b(b"%d|%d|%d|" % (r, left, size) + tweak, key=key[:64], digest_size=16).digest()
            left, right = (right - int.from_bytes(mixed, "big")) % side, left
        return left * side + right

    value = once(value)
    while value >= size:
        value = once(value)
    return value


def same_format(value: str, key: bytes, tweak: bytes = b"", back: bool = False) -> str:
    """Digits and ASCII letters permuted as one number in mixed radix, everything else left where it is."""
    digits = [(10, "0") if c in "0123456789" else (26, "A") if "A" <= c <= "Z" else (26, "a") if "a" <= c <= "z" else None for c in value]
    size, number = 1, 0
    for c, d in zip(value, digits, strict=True):
        if d:
            number, size = number * d[0] + ord(c) - ord(d[1]), size * d[0]
    if size < 2:
        return value
    number = (unfeistel if back else feistel)(number, size, key, tweak)
    out = list(value)
    for k in range(len(value) - 1, -1, -1):
        if d := digits[k]:
            number, r = divmod(number, d[0])
            out[k] = chr(ord(d[1]) + r)
    return "".join(out)


def canonical(value: str, kind: str) -> str:
    """What makes two spellings of a value equal."""
    if kind == "email":
        v = re.sub(r" ?(?:\(at\)|\[at\]|\{at\}|<at>| at |_at_) ?", "@", value.lower())
        return re.sub(r" ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |_dot_) ?", ".", v)
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    if kind == "name" and ", " in value:
        value = " ".join(reversed(value.split(", ", 1)))
    return " ".join(value.lower().split())


DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values: check letters by the remainder of 23
LONG_CODES = re.compile(r"2[1-689]|3[578]|42|5[09]|6[789]|8[058]|9[679]")  # fixed values: how country codes of three digits begin


def _numbers(text: str) -> int:
    """Letters and digits as one number, A being 10."""
    return int("".join(str(int(c, 36)) for c in text))


def _dni_letter(body: str) -> str:
    return DNI_LETTERS[int(body.translate(str.maketrans("XYZ", "012"))) % 23]


def _tax_digit(body: str) -> str:
    p = 10
    for c in body:
        p = 2 * ((int(c) + p) % 10 or 10) % 11
    return str((11 - p) % 10)


def _iban_digits(country: str, body: str) -> str:
    return f"{98 - _numbers(body + country + '00') % 97:02d}"


def checked(plain: str) -> str | None:
    """The kind of identity number whose check a plain value (letters and digits) passes, or None."""
    if re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", plain):
        return "dni" if _dni_letter(plain[:-1]) == plain[-1] else None
    if re.fullmatch(r"[12]\d{14}", plain):
        return "nir" if int(plain[13:]) == 97 - int(plain[:13]) % 97 else None
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", plain):
        return "iban" if _iban_digits(plain[:2], plain[4:]) == plain[2:4] else None
    if re.fullmatch(r"[1-9]\d{10}", plain):
        return "tax" if _tax_digit(plain[:10]) == plain[10] else None
    if re.fullmatch(r"\d{9}", plain):
        return "ssn" if plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000" else None
    return None


def number_pseudonym(plain: str, kind: str, key: bytes) -> str:
    """A pseudonym of a plain number, as long as it, that passes the check which the number passes."""
    tweak = kind.encode()
    shape = checked(plain) if kind == "id_number" else None
    if shape == "dni":
        head = plain[0] if plain[0] in "XYZ" else ""
        body = head + same_format(plain[len(head) : -1], key, tweak + head.encode())
        return body + _dni_letter(body)
    if shape == "nir":
        body = plain[0] + same_format(plain[1:13], key, tweak + plain[:1].encode())
        return body + f"{97 - int(body) % 97:02d}"
    if shape == "iban":
        body = same_format(plain[4:], key, tweak + plain[:2].encode())
        return plain[:2] + _iban_digits(plain[:2], body) + body
    if shape == "tax":
        body = str(feistel(int(plain[:10]) - 10**9, 9 * 10**9, key, tweak) + 10**9)
        return body + _tax_digit(body)
    if shape == "ssn":  # areas 001 to 899 without 666, groups from 01, serials from 0001
        area = int(plain[:3]) - 1 - (int(plain[:3]) > 666)
        number = feistel((area * 99 + int(plain[3:5]) - 1) * 9999 + int(plain[5:]) - 1, 898 * 99 * 9999, key, tweak)
        area, rest = divmod(number, 99 * 9999)
        return f"{area + 1 + (area >= 665):03d}{rest // 9999 + 1:02d}{rest % 9999 + 1:04d}"
    new = same_format(plain, key, tweak)
    while kind == "id_number" and checked(new):  # so that no two values get the same
        new = same_format(new, key, tweak)
    return new


def same_date(value: str, key: bytes) -> str:
    """A date of the years 1900 to 2099 in the layout of ``value``; what is no such date is permuted digit by digit."""
    a, b, c = re.split(r"[-./]", value)
    for order in ((0, 1, 2),) if len(a) == 4 else ((2, 1, 0), (2, 0, 1)):  # day first, else month first
        fields = [(a, b, c)[k] for k in order]
        try:
            day = date(*map(int, fields))
        except ValueError:
            continue
        if 1900 <= day.year <= 2099:
            first = date(1900, 1, 1).toordinal()
            new = date.fromordinal(first + feistel(day.toordinal() - first, date(2100, 1, 1).toordinal() - first, key, b"date"))
            parts = [""] * 3
            for k, x in zip(order, (new.year, new.month, new.day), strict=True):
                parts[k] = str(x) if k == order[0] else f"{x:02d}"
            return re.sub(r"\d+", lambda _, it=iter(parts): next(it), value)
    return same_format(value, key, b"date")


def placeholder(value: str, kind: str, key: bytes) -> str:
    """``[TYPE pseudonym]``: in the value's own layout for numbers and dates, a keyed tag for the rest."""
    if kind == "date":
        return f"[DATE {same_date(value, key)}]"
    if kind in ("phone", "id_number"):
        kept = 0
        if kind == "phone" and (m := re.match(r"\(?\+(\d)|(00)[1-9]", value)):  # the country code stays
            digits = re.sub(r"\D", "", value)[2 if m[2] else 0 :]
            kept = (2 if m[2] else 0) + (1 if digits[0] in "17" else 3 if LONG_CODES.match(digits) else 2)
        at = [k for k, c in enumerate(value) if c.isascii() and c.isalnum()][kept:]
        if kept and (trunk := value.find("(0)")) >= 0:
            at = [k for k in at if k != trunk + 1]
        code = canonical(value, kind)[2 if value.startswith("00") else 0 : kept]
        plain = "".join(value[k] for k in at).upper()
        out = list(value)
        for k, c in zip(at, number_pseudonym(plain, kind + code, key) if code else number_pseudonym(plain, kind, key), strict=True):
            out[k] = c
        return f"[{kind.upper()} {''.join(out)}]"
    tag = hashlib.blake2b(f"{kind}|{canonical(value, kind)}".encode(), key=key[:64], digest_size=5).hexdigest()
    return f"[{kind.upper()} {tag}]"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start_pos, end_pos, pii_type), positions in characters from 0, the end exclusive.

    Null and empty texts and texts without personal information give no rows; repeated documents are all answered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s, e, k) for i, t in zip(b["id"], b["t"], strict=True) for s, e, k in find(t)]
            yield pd.DataFrame(rows, columns=["id", "start_pos", "end_pos", "pii_type"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.length("t") > 0)
    return rows.mapInPandas(run, "id long, start_pos int, end_pos int, pii_type string")


def masked(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, n_masked): texts with placeholders, birth dates included; null and empty texts stay as they are.

    An empty key is an error, as its pseudonyms could be undone by anybody.
    """
    if not key:
        raise ValueError("a key is needed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, counts = [], []
            for t in b["t"]:
                found = _disjoint({*find(t), *((*m.span("d"), "date") for m in BIRTH.finditer(t))}) if t else []
                out, at = [], 0
                for s, e, k in found:
                    out += [t[at:s], placeholder(t[s:e], k, key)]
                    at = e
                texts.append("".join([*out, t[at:]]) if found else t)
                counts.append(len(found))
            yield pd.DataFrame({"id": b["id"], "text": texts, "n_masked": counts})

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInPandas(run, "id long, text string, n_masked int")
