"""Token classes, lexers and grammars of seven languages, as far as adjacency and statement shapes need them.

A grammar is written as productions over token classes. ``permitted`` derives from it every pair of classes that may
stand side by side in some sentence, by the usual first and last sets; with line ends that may stand for a separator, a
second set holds the pairs that may stand on both sides of one.
"""

from __future__ import annotations

import re
from functools import lru_cache


# ---------------------------------------------------------------- pairs from productions
def _parse(text: str):
    words = re.findall(r"[A-Za-z_]+|[()|?*+]", text)
    at = 0

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(words) and words[at] == "|":
            at += 1
            options.append(sequence())
        return ("or", options)

    def sequence():
        nonlocal at
        items = []
        while at < len(words) and words[at] not in "|)":
            if words[at] == "(":
                at += 1
                item = alternatives()
                at += 1
            else:
                item = ("name", words[at])
                at += 1
            while at < len(words) and words[at] in "?*+":
                item = (words[at], item)
                at += 1
            items.append(item)
        return ("seq", items)

    return alternatives()


def derive(productions: str, statement: str) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(pairs that may be adjacent, pairs that may be adjacent with a statement ending between them)."""
    rules = {k.strip(): _parse(v) for k, v in (line.split("=", 1) for line in productions.strip().splitlines() if "=" in line)}
    info = {k: (False, frozenset(), frozenset()) for k in rules}
    pairs: set[tuple[str, str]] = set()

    def walk(node):
        op = node[0]
        if op == "name":
            n = node[1]
            return info[n] if n in rules else (False, frozenset([n]), frozenset([n]))
        if op == "or":
            all_ = [walk(x) for x in node[1]]
            return any(x[0] for x in all_), frozenset().union(*(x[1] for x in all_)), frozenset().union(*(x[2] for x in all_))
        if op == "seq":
            empty, first, last = True, frozenset(), frozenset()
            for x in node[1]:
                e, f, la = walk(x)
                pairs.update((a, b) for a in last for b in f)
                first = first | f if empty else first
                last = last | la if e else la
                empty = empty and e
            return empty, first, last
        e, f, la = walk(node[1])
        if op in "*+":
            pairs.update((a, b) for a in la for b in f)
        return e or op in "?*", f, la

    while True:
        before, count = dict(info), len(pairs)
        for k, v in rules.items():
            info[k] = walk(v)
        if info == before and len(pairs) == count:
            break
    _, first, last = info[statement]
    return pairs, {(a, b) for a in last for b in first}


# Operators are written loosely: what binds how tightly does not matter to adjacency.
_COMMON = """
paren = LP list? RP
brack = LB list? RB
brace = LC body? RC
list = pun* (elem (pun+ elem)*)? pun*
"""
GRAMMARS = {
    "javascript": _COMMON
    + """
body = (part COMMA?)*
part = stmt | member
pun = COMMA | SEMI | COLON | Q
elem = expr | VAR expr
expr = un (op un)*
op = BIN | ADD | STAR | LT | GT | ASG | EQ | Q | COLON | ARROW | COMMA | INOP | MOD | EXT | Q COLON | COLON LT | EQ LT | GT EQ | GT COLON | GT ARROW | LT GT | GT GT | COLON BIN | EQ BIN | Q DOT
un = (ADD | NOT | INC | UNK | NEW | ELL | MOD | AT paren? | STAR | LT)* prim post*
prim = name | NUM | STR | paren | brack | brace | func | class
name = ID | MOD | DEF | UNK
word = name | NEW | FUNC | CLASS | VAR | IF | DO | ELSE | TRY | FIN | CATCH | RET | BRK | CASE | IMP | EXP | EXT | INOP
post = INC | DOT word | DOT paren | DOT brack | paren | brack | STR | NOT | GT paren | GT brack | GT brace | LB RB | generic
func = MOD* FUNC STAR? name? generic? paren (COLON expr)? brace
generic = LT list GT
class = CLASS name? generic? (EXT expr)? (MOD list)? brace
member = (MOD | AT paren? | STAR)* (word | STR | NUM | brack) (Q | NOT)? generic? (paren | COLON expr | EQ expr)* (brace | SEMI)?
stmt = expr SEMI? | VAR list SEMI? | VAR UNK list SEMI? | IF MOD? paren stmt | IF UNK paren stmt | DO stmt | ELSE stmt | TRY brace | CATCH paren? brace | FIN brace | RET expr? SEMI? | BRK ID? SEMI? | CASE expr COLON | DEF COLON | func | class | brace | SEMI | name COLON stmt | AT paren? stmt | IMP list? MOD? STR SEMI? | IMP STAR MOD name MOD STR SEMI? | IMP brace MOD STR SEMI? | IMP paren post* SEMI? | IMP DOT word post* | IMP STR brace? | EXP (stmt | DEF (expr | func | class) SEMI? | STAR (MOD name)? MOD STR SEMI? | brace (MOD STR)? SEMI? | MOD+ stmt | EQ expr) | MOD+ stmt | MOD name generic? (EXT expr)? (EQ BIN? expr)? brace? SEMI? | MOD CLASS | MOD FUNC | MOD VAR list | VAR MOD name brace | MOD STR brace
""",
    "go": _COMMON
    + """
body = (stmt | field SEMI)* (expr COMMA? | RET list? | BRK ID? | field | GO expr)?
field = ID (COMMA ID)* type STR? | type STR? | STAR ID (DOT ID)? STR? | ID paren type?
pun = COMMA | SEMI | COLON
elem = expr | type | ID type | ID ELL type | VAR expr | STR | ID STR
type = STAR* (ID (DOT ID)? brack? | MAP brack type | CHAN type? | ARR CHAN type | CHAN ARR type | FUNC paren type? | FUNC paren paren | STRUCT brace | IFACE brace | LB (NUM | ID | ELL)? RB type | paren) | ELL type | TILDE type
expr = un (op un)*
op = BIN | ADD | STAR | AMP | ARR | ASG | EQ | COLON | COMMA | NOT
un = (ADD | NOT | AMP | STAR | ARR | TILDE)* prim post*
prim = ID | NUM | STR | paren | brack type? | brack | brace | func | type | MAP brack type | STRUCT brace | RANGE expr
post = DOT ID | DOT paren | DOT LP TYPE RP | paren | brack | brace | ELL | INC
func = FUNC (paren)? (ID generic?)? paren (type | paren)? brace?
generic = brack
stmt = expr SEMI | PKG ID SEMI | IMP (STR | ID STR | DOT STR | paren) SEMI | func SEMI? | TYPE (ID generic? EQ? type | paren) SEMI? | VAR (list | ID type? (EQ expr)? | paren) SEMI | IF list? brace | ELSE (stmt | brace) | FOR list? brace | FOR RANGE expr brace | FOR SEMI | SWITCH list? brace | SELECT brace | CASE list COLON | DEF COLON | RET list? SEMI | BRK ID? SEMI | GO expr SEMI | brace SEMI? | SEMI | ID COLON
file = stmt*
""",
    "java": _COMMON
    + """
body = (stmt | member | ID paren? brace? (COMMA | SEMI))* (expr COMMA? | ID paren? brace?)?
pun = COMMA | SEMI | COLON
elem = expr | decl | type | ann* decl | decl EQ expr
type = (ANN | MODS)* (PRIM | ID) (DOT ID)* generic? (LB RB)* ELL?
generic = LT (targ (COMMA targ)*)? GT
targ = type | Q ((EXT | SUPER) type)? | ID EXT type (AMP type)*
decl = MODS* type ID
expr = un (op un)*
op = BIN | ADD | STAR | AMP | LT | GT | ASG | EQ | Q | COLON | ARROW | COMMA | INST | GT GT | Q COLON
un = (ADD | NOT | INC | cast)* prim post*
cast = LP type (AMP type)* RP
prim = ID | NUM | STR | paren | brace | NEW type (paren brace? | brack+ | brace)? | THIS | SUPER | PRIM | SWITCH paren brace | brack
post = INC | DOT (ID | NEW | THIS | SUPER | CLASS) | DOT generic ID | paren | brack | DC (ID | NEW) | brace | GT paren | ARROW
member = ann* MODS* generic? type? ID paren (LB RB)* throws? (brace | DEF prim SEMI | SEMI) | ann* MODS* type ID (LB RB)* (EQ expr)? SEMI | MODS* brace
throws = THROWS list
ann = ANN (DOT ID)* paren?
class = ann* MODS* (CLASS | ENUM) ID generic? paren? (EXT list)? (IMPL list)? (IMPL list)? brace | ann* MODS* ANN CLASS ID brace
stmt = expr SEMI | decl (LB RB)* (EQ expr)? SEMI | ann* MODS* type list SEMI | PKG ID (DOT ID)* SEMI | IMP MODS? ID (DOT (ID | STAR))* SEMI | class | IF paren stmt | IF LP list RP | DO stmt | ELSE stmt | TRY paren? brace | CATCH paren brace | FIN brace | RET expr? SEMI | BRK ID? SEMI | CASE list (COLON | ARROW) | DEF (COLON | ARROW) | SWITCH paren brace | brace | SEMI | MODS paren brace | ID COLON stmt | ann stmt | MODS stmt
file = stmt*
""",
    "c": _COMMON
    + """
body = (stmt | init COMMA)* (init COMMA?)?
init = DOT ID EQ expr | brack EQ expr | expr
pun = COMMA | SEMI | COLON | ELL
elem = expr | decl | type | decl EQ expr
tag = STRUCT ID? brace? | STRUCT ID
type = (TY | tag)+ ID* STAR* TY* | ID STAR* | ID TY* STAR*
decl = type+ (ID | paren) (paren | brack)*
expr = un (op un)*
op = BIN | ADD | STAR | AMP | ASG | EQ | Q | COLON | COMMA
un = (ADD | NOT | INC | STAR | AMP | SIZEOF | LP type STAR* RP)* prim post*
prim = ID | NUM | STR+ | paren | brace | LP type RP | STR ID STR | ID STR
post = INC | DOT ID | paren | brack | brace
stmt = expr SEMI | decl (COLON NUM)? ((EQ expr)? (COMMA STAR* ID (EQ expr)?)*) SEMI | decl brace | type SEMI | TYPEDEF type* list SEMI | tag SEMI | tag brace ID? SEMI | IF paren stmt | DO stmt | ELSE stmt | RET expr? SEMI | BRK ID? SEMI | CASE expr COLON | DEF COLON | brace | SEMI | ID COLON | TY* STR brace | ID paren | type brace
file = stmt*
""",
    "rust": _COMMON
    + """
body = (stmt | field COMMA | arm COMMA? | expr COMMA)* (expr | field | arm)? COMMA?
field = attr* vis? ID COLON type | ID COLON expr | vis type
arm = pat (IF expr)? FAT expr
pat = BIN? patom ((BIN | AT | ELL | COLON) patom)* ELL?
patom = (AMP | REF | MUT | BIN | ADD)* (ID (DC ID)* (paren | brace)? | NUM | STR | paren | brack | ELL)
pun = COMMA | SEMI | COLON | FAT
elem = expr | type | pat | self | attr | vis type | LIFE | MUT ID | attr vis? elem
self = AMP? LIFE? MUT? ID
vis = PUB paren?
attr = HASH NOT? brack
type = (AMP | STAR | LIFE | MUT | CONST | DYN | IMPL | Q | BIN | NOT | UNSAFE | EXTERN STR? | FOR generic)* (ID | paren | brack | FN paren (ARROW type)? | NOT) (DC (ID | generic))* generic? (paren)? (ARROW type)? ((ADD) type)* (AS type)?
generic = LT (garg (COMMA garg)* COMMA?)? GT
garg = LIFE (COLON list)? | CONST? type (COLON type)? (EQ expr)? | NUM | STR | brace
expr = un (op un)*
op = BIN | ADD | STAR | AMP | LT | GT | ASG | EQ | AS | ELL | COLON | COMMA | FAT | ARROW | Q | AT | GT GT
un = (ADD | NOT | STAR | AMP | MUT | REF | ELL | MOVE | UNSAFE | ASYNC | BIN | LIFE COLON | BOX)* prim post*
prim = ID | NUM | STR | paren | brack | brace | closure | IF expr brace (ELSE (IF expr)? brace)? | MATCH expr brace | LOOP brace | FOR pat IN expr brace | IF LET pat EQ expr | RET expr? | BRK LIFE? expr? | ELL | type
closure = BIN (list BIN)? (ARROW type)? expr
post = Q | DOT (ID | NUM) | paren | brack | brace | DC (ID | generic | STAR | brace) | NOT (paren | brack | brace) | ELL | LIFE
where = WHERE list
fn = (CONST | ASYNC | UNSAFE | EXTERN STR?)* FN ID generic? paren (ARROW type)? where? (brace | SEMI)
stmt = attr | vis stmt | expr SEMI | IF expr brace (ELSE (IF expr)? brace)? | IF LET pat EQ expr brace | MATCH expr brace | LOOP brace | FOR pat IN expr brace | LET pat (COLON type)? (EQ expr (ELSE brace)?)? SEMI | USE (DC? (ID | brace | STAR) (DC (ID | brace | STAR))* (AS ID)?) SEMI | MOD ID (brace | SEMI) | fn | STRUCT ID generic? where? (brace | paren where? SEMI | SEMI) | UNSAFE? IMPL generic? NOT? type (FOR type)? where? brace | TRAIT ID generic? (COLON type)? where? brace | (CONST | STATIC) MUT? ID COLON type (EQ expr)? SEMI | TYPE ID generic? (COLON type)? (EQ type)? SEMI | EXTERN STR? brace | EXTERN ID ID SEMI | UNSAFE brace | SEMI | brace | ID NOT ID? (brace | paren | brack) SEMI? | WHILE expr brace | WHILE LET pat EQ expr brace | LIFE COLON stmt
file = stmt*
""",
    "python": _COMMON
    + """
body = list
pun = COMMA | COLON | STAR
elem = expr
inner = COMMA | STAR
paren = LP inner* (elem (inner+ elem)*)? inner* RP
expr = un (op un)*
op = BIN | ADD | STAR | EQ | ASG | COMMA | COLON | INOP | IF | ELSE | FOR | AS | WALRUS | ARROW | FROM | BIN COMMA
un = (ADD | NOT | STAR | LAMBDA | UNK | TILDE | COLON)* prim post*
prim = ID | NUM | STR+ | paren | brack | brace | SOFT | LAMBDA COLON | LAMBDA expr COLON | FOR | ELL
post = DOT (ID | SOFT) | paren | brack | COLON | FOR | ASYNC FOR
head = DEF (ID | SOFT) brack? paren (ARROW expr)? COLON | CLASS (ID | SOFT) brack? paren? COLON | IF expr COLON | WHILE expr COLON | ELSE COLON | FOR expr COLON | TRY COLON | EXCEPT STAR? expr? COLON | FIN COLON | WITH list COLON | ASYNC head | SOFT expr COLON
simple = expr | RET list? | RAISE list? | BRK | IMP list | FROM (DOT | ELL)* (ID | SOFT)? (DOT ID)* IMP (STAR | paren | list) | ASSERT list | DEL list | GLOBAL list | UNK expr? | SOFT (ID | SOFT) brack? EQ list
line = simple (SEMI simple)* SEMI? NL | head simple (SEMI simple)* SEMI? NL | head NLC INDENT | AT expr NL | DEDENT
stmt = line
file = stmt*
""",
}
GRAMMARS["typescript"] = GRAMMARS["javascript"]
# without types, generics, optional marks, assertions and modifiers; ``as`` (AS) only renames
GRAMMARS["javascript"] = _COMMON + """
body = (part COMMA?)*
part = stmt | member
pun = COMMA | SEMI | COLON
elem = expr | VAR expr
expr = un (op un)*
op = BIN | ADD | STAR | LT | GT | ASG | EQ | Q | COLON | ARROW | COMMA | INOP | MOD | AS | EXT | LT GT
un = (ADD | NOT | INC | UNK | NEW | ELL | MOD | AT paren? | STAR | LT)* prim post*
prim = name | NUM | STR | paren | brack | brace | func | class
name = ID | MOD | AS | DEF | UNK
word = name | NEW | FUNC | CLASS | VAR | IF | DO | ELSE | TRY | FIN | CATCH | RET | BRK | CASE | IMP | EXP | EXT | INOP
post = INC | DOT word | DOT paren | DOT brack | paren | brack | STR
func = MOD* FUNC STAR? name? paren brace
class = CLASS name? (EXT expr)? brace
member = (MOD | AT paren? | STAR)* (word | STR | NUM | brack) (paren | COLON expr | EQ expr)* (brace | SEMI)?
stmt = expr SEMI? | VAR list SEMI? | VAR UNK list SEMI? | IF MOD? paren stmt | IF UNK paren stmt | DO stmt | ELSE stmt | TRY brace | CATCH paren? brace | FIN brace | RET expr? SEMI? | BRK ID? SEMI? | CASE expr COLON | DEF COLON | func | class | brace | SEMI | name COLON stmt | AT paren? stmt | IMP list? MOD? STR SEMI? | IMP STAR AS name MOD STR SEMI? | IMP brace MOD STR SEMI? | IMP paren post* SEMI? | IMP DOT word post* | IMP STR (ID brace)? | EXP (VAR list SEMI? | func | class | DEF (expr | func | class) SEMI? | STAR (AS (name | STR))? MOD STR SEMI? | brace (MOD STR)? SEMI? | AT paren? stmt)
"""


@lru_cache(maxsize=None)
def permitted() -> tuple[tuple[str, str, str], ...]:
    """Rows (language, a, b): class b may follow class a. A line end between them is written as a class ``^b``."""
    rows: set[tuple[str, str, str]] = set()
    for language, g in GRAMMARS.items():
        direct, across = derive(g, "stmt")
        if language in ("javascript", "typescript"):
            # two statements or members need a line end, a separator or a block's end between them
            inside, juxtaposed = derive(g.replace("body = (part COMMA?)*", "body = part COMMA?"), "part")
            across, direct = across | juxtaposed, inside | {(a, b) for a, b in across | juxtaposed if a in ("SEMI", "RC", "LC", "COMMA")}
        rows |= {(language, a, b) for a, b in direct if language in ("javascript", "typescript")} | {(language, a, b) for a, b in direct | across if language not in ("javascript", "typescript")}
        rows |= {(language, a, "^" + b) for a, b in direct | across}
        first, last = ends(g)
        first -= {"LT"} if language in ("javascript", "typescript") else set()
        rows |= {(language, "BOF", x) for x in first} | {(language, x, "EOF") for x in last}
    return tuple(sorted(rows))


def ends(productions: str) -> tuple[set[str], set[str]]:
    """The classes that a statement can begin and end with."""
    marked, _ = derive(productions + "\nwhole = BOF stmt EOF", "stmt")
    return {b for a, b in marked if a == "BOF"}, {a for a, b in marked if b == "EOF"}


# ---------------------------------------------------------------- lexers
def _table(**groups: str) -> dict[str, str]:
    return {w: k for k, v in groups.items() for w in v.split()}


#: fixed values: the keywords of each language, by the part they play in the grammars above
KEYWORDS = {
    "javascript": _table(FUNC="function", CLASS="class", NEW="new", UNK="typeof void delete await yield", VAR="var let const", IF="if while for switch with", DO="do", ELSE="else", TRY="try", FIN="finally", CATCH="catch", RET="return throw", BRK="break continue debugger", CASE="case", DEF="default", IMP="import", EXP="export", EXT="extends", INOP="in instanceof", MOD="async of get set static from as type interface readonly public private protected declare abstract enum namespace module keyof is satisfies implements infer unique override asserts accessor"),
    "go": _table(PKG="package", IMP="import", FUNC="func", TYPE="type", VAR="var const", IF="if", ELSE="else", FOR="for", RANGE="range", SWITCH="switch", SELECT="select", CASE="case", DEF="default", RET="return", BRK="break continue goto fallthrough", GO="go defer", MAP="map", CHAN="chan", STRUCT="struct", IFACE="interface"),
    "java": _table(PKG="package", IMP="import", CLASS="class interface", ENUM="enum", EXT="extends", IMPL="implements permits", THROWS="throws", MODS="public private protected static final abstract synchronized native transient volatile strictfp", PRIM="int long short byte char float double boolean void", NEW="new", THIS="this", SUPER="super", IF="if while for", DO="do", ELSE="else", TRY="try", CATCH="catch", FIN="finally", RET="return throw assert", BRK="break continue", CASE="case", DEF="default", SWITCH="switch", INST="instanceof"),
    "c": _table(TY="int long short char float double void signed unsigned const volatile static extern inline register auto restrict _Bool _Noreturn", STRUCT="struct union enum", TYPEDEF="typedef", SIZEOF="sizeof _Alignof", IF="if while for switch", DO="do", ELSE="else", RET="return", BRK="break continue goto", CASE="case", DEF="default"),
    "rust": _table(FN="fn", PUB="pub", LET="let", MUT="mut", REF="ref", USE="use", MOD="mod", STRUCT="struct enum union", IMPL="impl", TRAIT="trait", TYPE="type", CONST="const", STATIC="static", EXTERN="extern", UNSAFE="unsafe", ASYNC="async", MOVE="move", DYN="dyn", IF="if", ELSE="else", MATCH="match", LOOP="loop", WHILE="while", FOR="for", IN="in", RET="return", BRK="break continue", AS="as", WHERE="where"),
    "python": _table(DEF="def", CLASS="class", IF="if elif", ELSE="else", WHILE="while", FOR="for", TRY="try", EXCEPT="except", FIN="finally", WITH="with", RET="return", RAISE="raise", BRK="break continue pass", IMP="import", FROM="from", ASSERT="assert", DEL="del", GLOBAL="global nonlocal", LAMBDA="lambda", NOT="not", INOP="in is and or", AS="as", ASYNC="async", UNK="await yield", SOFT="match case type"),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]
KEYWORDS["javascript"] = {w: k for w, k in KEYWORDS["typescript"].items() if k != "MOD"} | _table(MOD="async of get set static from accessor", AS="as")
_OPEN = {"(": "LP", "[": "LB", "{": "LC", ")": "RP", "]": "RB", "}": "RC", ";": "SEMI", ",": "COMMA", ".": "DOT", "...": "ELL", ":": "COLON", "?": "Q", "@": "AT"}
OPERATORS = {
    "javascript": _OPEN | {"?.": "DOT", "=>": "ARROW", "=": "EQ", "<": "LT", ">": "GT", "+": "ADD", "-": "ADD", "*": "STAR", "++": "INC", "--": "INC", "!": "NOT", "~": "NOT"},
    "go": _OPEN | {"=": "EQ", ":=": "ASG", "+": "ADD", "-": "ADD", "*": "STAR", "&": "AMP", "<-": "ARR", "++": "INC", "--": "INC", "!": "NOT", "^": "NOT", "~": "TILDE"},
    "java": _OPEN | {"=": "EQ", "->": "ARROW", "::": "DC", "<": "LT", ">": "GT", "+": "ADD", "-": "ADD", "*": "STAR", "&": "AMP", "++": "INC", "--": "INC", "!": "NOT", "~": "NOT"},
    "c": _OPEN | {"->": "DOT", "=": "EQ", "+": "ADD", "-": "ADD", "*": "STAR", "&": "AMP", "++": "INC", "--": "INC", "!": "NOT", "~": "NOT"},
    "rust": _OPEN | {"::": "DC", "=>": "FAT", "->": "ARROW", "..": "ELL", "..=": "ELL", "=": "EQ", "<": "LT", ">": "GT", "+": "ADD", "-": "ADD", "*": "STAR", "&": "AMP", "!": "NOT", "#": "HASH"},
    "python": _OPEN | {"->": "ARROW", "=": "EQ", ":=": "WALRUS", "+": "ADD", "-": "ADD", "*": "STAR", "**": "STAR", "~": "TILDE"},
}
OPERATORS["typescript"] = OPERATORS["javascript"]
_PUNCT = {
    "javascript": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[-+*/%<>=!&|^~?:;,.(){}\[\]@#]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%<>=!&|^~:;,.(){}\[\]]",
    "java": r"\.\.\.|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|[-+*/%<>=!&|^~?:;,.(){}\[\]@]",
    "c": r"\.\.\.|<<=|>>=|->|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%<>=!&|^~?:;,.(){}\[\]]",
    "rust": r"<<=|>>=|\.\.\.|\.\.=|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%<>=!&|^?:;,.(){}\[\]@#$~]",
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|>>|<<|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@<>=&|^~:;,.(){}\[\]]",
}
_ID = r"[^\W\d][\w$]*"
_NUM = r"0[xX][\da-fA-F_]+\w*|0[bBoO][\d_]+\w*|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[a-zA-Z_]*\d*"
_RNUM = r"0[xX][\da-fA-F_]+\w*|0[bBoO][\d_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?(?:[iuf]\d*\w*)?"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_MERGE = r"(?P<bad>^(?:<{7}|>{7}|\|{7}|={7})(?=[ \r\n]|$).*$)"
_C = r"(?P<gap>[^\S\n]+|//.*|/\*[\s\S]*?\*/)|(?P<nl>\n)"
_SHAPES = {
    "javascript": rf"{_MERGE}|{_C}|(?P<str>{_DQ}|{_SQ})|(?P<tick>`)|(?P<num>{_NUM})|(?P<id>#?[^\W\d][\w$]*|\$[\w$]*)",
    "go": rf"{_MERGE}|{_C}|(?P<str>{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)')|(?P<num>{_NUM})|(?P<id>[^\W\d]\w*)",
    "java": rf'{_MERGE}|{_C}|(?P<str>"""[\s\S]*?"""|{_DQ}|\'(?:[^\'\\\n]|\\[^\'\n]+|\\\')\')|(?P<num>{_NUM})|(?P<id>{_ID})',
    "c": rf"{_MERGE}|(?P<dir>^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)|{_C}|(?P<str>(?:u8|[uUL])?{_DQ}|[uUL]?'(?:[^'\\\n]|\\[^'\n]+|\\')+')|(?P<num>{_NUM})|(?P<id>{_ID})",
    "rust": rf"{_MERGE}|{_C}|(?P<str>b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|[^\n]))')|(?P<life>'[^\W\d]\w*)|(?P<num>{_RNUM})|(?P<id>(?:r\#)?[^\W\d]\w*)",
    "python": rf"{_MERGE}|(?P<gap>[ \t\f]+|\#.*|\\\n)|(?P<nl>\n)|(?P<str>(?i:[rbuft]{{0,2}})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))|(?P<num>{_NUM})|(?P<id>[^\W\d]\w*)",
}
_LEX = {k: re.compile(rf"{v}|(?P<op>{_PUNCT[k]})|(?P<odd>[\s\S])", re.M) for k, v in _SHAPES.items()}
_LEX["typescript"] = _LEX["javascript"]
DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif pragma error warning line import elifdef elifndef embed".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_AFTER_OPERAND = frozenset("ID NUM STR RP RB RC INC MOD AS".split())
_GO_ENDS = frozenset("ID NUM STR RP RB RC INC RET BRK".split())


def _template(text: str, at: int) -> int:
    """The place after a template literal whose opening tick lies before ``at``; -1 if it does not end."""
    depth: list[int] = []
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if depth and depth[-1] >= 0:
            if c == "{":
                depth[-1] += 1
            elif c == "}":
                if depth[-1] == 0:
                    depth.pop()
                else:
                    depth[-1] -= 1
            elif c == "`":
                depth.append(-1)
            elif c in "\"'":
                m = re.compile(_DQ if c == '"' else _SQ).match(text, at)
                at = m.end() if m else at + 1
                continue
        elif c == "`":
            if not depth:
                return at + 1
            depth.pop()
        elif c == "$" and text.startswith("${", at):
            depth.append(0)
            at += 1
        at += 1
    return -1


_TAG = re.compile(r"<(?:(/?)([A-Za-z][\w.:-]*)?((?:[^<>{}\"']|\"[^\"]*\"|'[^']*'|=>|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*?)(/?))>")


def _markup(text: str, at: int) -> int:
    """The place after an element of markup in an expression that begins at ``at``; -1 if there is none."""
    depth = 0
    while m := _TAG.search(text, at):
        if depth == 0 and m.start() != at:
            return -1
        depth += -1 if m[1] else 0 if m[4] else 1
        at = m.end()
        if depth <= 0:
            return at if depth == 0 else -1
    return -1


def lex(text: str, language: str) -> list[str]:
    """The token classes of a text; ``^`` before a class says that a line ended before it, ERR that it cannot be read.

    Python's indentation comes as INDENT and DEDENT, its logical lines end in NL, Go's inserted semicolons are SEMI.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if text.startswith("#!"):
        text = "//" + text[2:] if language in ("javascript", "typescript", "go", "java", "rust") and not text.startswith("#![") else text
    words, ops, scan = KEYWORDS[language], OPERATORS[language], _LEX[language]
    out: list[str] = []
    at, n, last, line_end = 0, len(text), "", False
    js, py, go = language in ("javascript", "typescript"), language == "python", language == "go"
    depth, indents, fresh = 0, [0], True
    while at < n:
        if py and fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest not in ("", "\n", "#"):
                width = len(m[0].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append("INDENT")
                while width < indents[-1]:
                    indents.pop()
                    out.append("DEDENT")
                if width != indents[-1]:
                    out.append("ERR")
                last = ""
            fresh = False
        m = scan.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "h":
            kind = "str"
        if kind == "gap":
            line_end = line_end or (not py and "\n" in m[0])
            if go and "\n" in m[0] and last in _GO_ENDS:
                out.append("SEMI")
                last = "SEMI"
            continue
        if kind == "nl":
            line_end = True
            if py:
                fresh = True
                if not depth and last and last not in ("NL", "NLC"):
                    last = "NLC" if last == "COLON" else "NL"
                    out.append(last)
            elif go and last in _GO_ENDS:
                out.append("SEMI")
                last = "SEMI"
            continue
        if kind == "id":
            cls = words.get(m[0], "ID")
            if language == "java" and last == "ANN":
                cls = "CLASS" if m[0] == "interface" else "ID"
                if cls == "ID":
                    continue
            elif js and last == "AT":
                continue
        elif kind == "op":
            cls = ops.get(m[0], "ASG" if m[0].endswith("=") and m[0] not in ("==", "!=", "<=", ">=", "===", "!==") else "BIN")
            if js and cls in ("BIN", "ASG") and m[0][0] == "/" and last not in _AFTER_OPERAND:
                r = _REGEX.match(text, m.start())
                if r:
                    cls, at = "STR", r.end()
            elif js and cls == "LT" and last and last not in _AFTER_OPERAND and (end := _markup(text, m.start())) > 0:
                cls, at = "STR", end
            elif language == "java" and cls == "AT":
                cls = "ANN"
            elif py and m[0] == "@" and last not in ("", "NL", "NLC", "INDENT", "DEDENT"):
                cls = "BIN"
            if cls in ("LP", "LB", "LC"):
                depth += 1
            elif cls in ("RP", "RB", "RC"):
                depth -= 1
                depth = max(depth, 0)
        elif kind == "tick":
            end = _template(text, at)
            cls, at = ("STR", end) if end > 0 else ("ERR", n)
        elif kind == "dir":
            name = re.match(r"\s*#\s*(\w*)", m[0])[1]
            if name and name not in DIRECTIVES:
                out.append("ERR")
            line_end = True
            continue
        else:
            cls = {"str": "STR", "num": "NUM", "life": "LIFE"}.get(kind, "ERR")
        out.append("^" + cls if line_end and out and not py else cls)
        last, line_end = cls, False
    if not out:
        return []
    if py:
        if last and last not in ("NL", "NLC"):
            out.append("NLC" if last == "COLON" else "NL")
        out += ["DEDENT"] * (len(indents) - 1)
    elif go and last in _GO_ENDS:
        out.append("SEMI")
    return ["BOF", *out, "EOF"]
