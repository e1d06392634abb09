"""Bundled grammars of the languages of the index: productions and lexemes as data, read by `glr` and `parsing`.

A grammar accepts what its language's own grammar accepts, as far as it is written down here. It is flat where only
recognition matters: operators have no precedence, and targets of assignments are operands. Rules beyond the grammar
(names, types, what may be assigned) are not its concern.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Spec:
    rules: str
    lexemes: str  # named groups: skip, bad, and terminals of the grammar (ID comes last and is added)
    name: str = r"[^\W\d]\w*"
    soft: str = ""  # words that are keywords in places, and names elsewhere
    classes: dict[str, str] = field(default_factory=dict)  # terminals that stand for several signs
    layout: str = ""  # how line ends count: "indent", "semicolon" (after `ends`), "line" (after `ends`, unless before `joins`), "offence"
    ends: str = ""  # terminals after which a line end counts
    joins: str = ""  # tokens before which it doesn't
    value: str = ""  # terminals after which a slash divides and `<` compares: no pattern or markup begins there
    pattern: str = ""  # a literal that begins elsewhere
    shapes: dict[str, str] = field(default_factory=dict)  # terminals that names of a shape may stand for
    markup: bool = False  # elements of markup may be operands


_C = r"(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<bad>/\*)"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_CHR = r"'(?:[^'\\\n]|\\(?:u+\{?[0-9a-fA-F]+\}?|x[0-9a-fA-F]+|[0-7]{1,3}|U[0-9a-fA-F]{8}|.))'"
_DEC = r"(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"

RUST = Spec(
    lexemes=r"(?P<skip>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)|(?P<bad>/\*)|(?P<STR>[bc]?r(?P<h>#*)\".*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*\"|b?" + _CHR + r")|(?P<LIFE>'[A-Za-z_]\w*)|(?P<NUM>0x[\da-fA-F_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w+)?)",
    name=r"(?:r#)?[^\W\d]\w*",
    soft="union auto default raw macro_rules gen safe",
    classes={"BIN": "/ % ^ == != <= >= += -= *= /= %= ^= &= |= <<= >>= <<", "RANGE": ".. ..=", "OTHER": "$ ~ @ \\"},
    rules="""
file: inner* item*
inner: '#' '!' '[' tree* ']'
outer: '#' '[' tree* ']'
tree: '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | ANY
item: outer* vis? decl | outer* macro ';' | outer* bracemacro
vis: 'pub' | 'pub' '(' ('crate' | 'self' | 'super' | 'in' epath) ')'
decl: fn | 'struct' ID generics? where? '{' fields? '}' | 'struct' ID generics? ('(' (outer* vis? type) %% ',' ')')? where? ';' | 'struct' ID generics? '(' ')' where? ';'
  | 'enum' ID generics? where? '{' (variant %% ',')? '}' | 'union' ID generics? where? '{' fields? '}'
  | 'unsafe'? 'auto'? 'trait' ID generics? (':' bounds?)? where? '{' inner* item* '}' | 'trait' ID generics? '=' bounds? where? ';'
  | implhead where? '{' inner* item* '}' | 'unsafe'? 'mod' ID (';' | '{' inner* item* '}') | 'use' usetree ';'
  | 'const' (ID | '_') ':' type ('=' expr)? ';' | 'unsafe'? 'static' 'mut'? ID ':' type ('=' expr)? ';'
  | 'type' ID generics? (':' bounds?)? where? ('=' type)? where? ';' | 'unsafe'? 'extern' STR? '{' inner* item* '}'
  | 'extern' 'crate' (ID | 'self') ('as' (ID | '_'))? ';'
implhead: 'default'? 'unsafe'? 'impl' generics? ('const'? '!'? type 'for')? type
fields: (outer* vis? ID ':' type) %% ','
variant: outer* vis? ID variantbody? ('=' expr)?
variantbody: '{' fields? '}' | '(' ((outer* vis? type) %% ',')? ')'
fn: fnquals? 'fn' ID generics? '(' (param %% ',')? ')' ('->' type)? where? (block | ';')
fnquals: ('const' | 'async' | 'unsafe' | 'extern' STR? | 'default' | 'safe' | 'gen')+
param: outer* pat ':' type | outer* selfparam (':' type)? | outer* '...' | outer* pat ':' '...'
selfparam: ('&' LIFE?)? 'mut'? 'self'
generics: '<' (gparam %% ',')? '>'
gparam: outer* LIFE (':' (LIFE %% '+')?)? | outer* ID (':' bounds?)? ('=' type)? | outer* 'const' ID ':' type ('=' carg)?
carg: lit | '-' lit | block | ID
where: 'where' (wherepred %% ',')?
wherepred: LIFE ':' (LIFE %% '+')? | hrtb? type ':' bounds?
hrtb: 'for' generics
bounds: bound %% '+'
bound: LIFE | ('?' | '~' 'const' | 'async' | 'const')? hrtb? tpath | '(' '?'? hrtb? tpath ')' | 'use' generics
usetree: ('::'? epath '::' | '::')? ('*' | '{' (usetree %% ',')? '}') | '::'? epath ('as' (ID | '_'))?
type: '(' (type %% ',')? ')' | '[' type (';' expr)? ']' | ('&' | '&&') LIFE? 'mut'? type | '*' ('const' | 'mut') type | tpath | '!' | '_' | hrtb? fnptr | 'dyn' bounds | 'impl' bounds | hrtb tpath | tpath '!' group
fnptr: ('unsafe' | 'extern' STR?)* 'fn' '(' (fnarg %% ',')? ')' ('->' type)?
fnarg: outer* ((ID | '_') ':')? type | '...'
tpath: '::'? tseg % '::'
tseg: nameish | targs | nameish targs | nameish '(' (type %% ',')? ')' ('->' type)? | '<' type 'as' tpath '>'
nameish: ID | 'self' | 'Self' | 'super' | 'crate'
targs: '<' (targ %% ',')? '>'
targ: type | LIFE | lit | '-' lit | block | ID targs? '=' (type | lit | block) | ID targs? ':' bounds
lit: NUM | STR+ | 'true' | 'false'
pat: '|'? patone % '|'
patone: '_' | '..' | patlit | patend RANGES patend? | RANGES patend | 'ref'? 'mut'? ID ('@' patone)? | epath | epath '(' (pat %% ',')? ')' | epath '{' (fieldpat %% ',')? '}' | '(' (pat %% ',')? ')' | '[' (pat %% ',')? ']' | ('&' | '&&') 'mut'? patone | epath '!' group | 'box' patone | 'const' block
RANGES: RANGE | '...'
patlit: lit | '-' lit
patend: patlit | epath
fieldpat: outer* (ID | NUM) ':' pat | outer* 'box'? 'ref'? 'mut'? ID | outer* '..'
epath: '::'? eseg % '::'
eseg: nameish | targs | '<' type 'as' tpath '>'
group: '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
macro: epath '!' ID? ('(' tree* ')' | '[' tree* ']')
bracemacro: epath '!' ID? '{' tree* '}'
block: '{' inner* stmt* expr? '}'
stmt: ';' | item | outer* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | outer* expr ';' | outer* blocklike
blocklike: (LIFE ':')? bare | bracemacro
bare: 'if' expr block ('else' (bare_if | block))? | 'match' expr '{' inner* arms? '}' | 'loop' block | 'while' expr block | 'for' pat 'in' expr block | ('unsafe' | 'const' | 'async' 'move'? | 'gen' 'move'? | 'try') block | block
bare_if: 'if' expr block ('else' (bare_if | block))?
arms: arm* (arm | armhead expr)
arm: armhead expr ',' | armhead blocklike ','?
armhead: outer* pat ('if' expr)? '=>'
expr: link* operand | link* tail | link* operand RANGE | RANGE
link: operand binop | RANGE
binop: BIN | '+' | '-' | '*' | '&' | '&&' | '|' | '||' | '<' | '>' | '>' '>' | '=' | RANGE
operand: unop* prim
unop: '-' | '*' | '!' | ('&' | '&&') 'mut'? | '&' 'raw' ('const' | 'mut') | 'let' pat '='
tail: unop* closure | unop* 'return' expr? | unop* 'break' LIFE? expr? | unop* 'yield' expr? | 'become' expr
closure: hrtb? ('static' | 'async' | 'move')* ('|' (cparam %% ',')? '|' | '||') (expr | '->' type block)
cparam: outer* patone (':' type)?
prim: lit | epath | epath '{' (finit %% ',')? '}' | '(' (expr %% ',')? ')' | '[' inner* (expr %% ',')? ']' | '[' expr ';' expr ']' | blocklike | macro | 'continue' LIFE? | '_' | prim '.' ID ('::' targs)? | prim '.' 'await' | prim '.' NUM | prim '(' (expr %% ',')? ')' | prim '[' expr ']' | prim '?' | prim 'as' type | outer prim
finit: outer* (ID | NUM) ':' expr | outer* ID | outer* '..' expr?
""",
)

JAVA = Spec(
    lexemes=_C + rf"|(?P<STR>\"\"\"(?:[^\\]|\\.)*?\"\"\"|{_DQ}|{_CHR})|(?P<NUM>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|{_DEC}[lLfFdD]?)",
    name=r"(?:[^\W\d]|\$)[\w$]*",
    soft="var record sealed permits yield non module open exports when with",
    classes={"BIN": "/ % ^ == != <= >= += -= *= /= %= ^= &= |= <<= >>= >>>= && || << |", "PRIM": "int long short byte char float double boolean"},
    rules="""
file: (annot* 'package' qname ';')? (import | ';')* (typedecl | ';')*
import: 'import' 'static'? qname ('.' '*')? ';' | 'import' 'module' qname ';'
qname: ID % '.'
annot: '@' qname ('(' (annarg %% ',')? ')')?
annarg: (ID '=')? annval
annval: expr | annot | '{' (annval %% ',')? '}'
mods: (annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')+
typedecl: mods? 'class' ID tparams? ('extends' type)? ('implements' types)? ('permits' types)? body
  | mods? 'interface' ID tparams? ('extends' types)? ('permits' types)? body
  | mods? 'record' ID tparams? '(' params? ')' ('implements' types)? body
  | mods? '@' 'interface' ID body
  | mods? 'enum' ID ('implements' types)? '{' (constant %% ',')? ','? (';' member*)? '}'
constant: annot* ID args? body?
types: type % ','
body: '{' member* '}'
member: ';' | 'static'? block | typedecl | mods? tparams? (type | 'void') ID '(' params? ')' dims? throws? ends | mods? tparams? ID '(' params? ')' throws? block | mods? type vars ';' | mods? ID block
ends: block | ';' | 'default' annval ';'
throws: 'throws' types
dims: (annot* '[' ']')+
type: (PRIM | cname) dims?
cname: (annot* ID targs?) % '.'
targs: '<' (targ % ',')? '>'
targ: annot* type | annot* '?' (('extends' | 'super') type)?
tparams: '<' tparam % ',' '>'
tparam: annot* ID ('extends' type % '&')?
params: param % ','
param: pmod* type (annot* '...')? ID dims? | pmod* type (ID '.')? 'this'
pmod: annot | 'final'
vars: variable % ','
variable: ID dims? ('=' init)?
init: expr | '{' (init %% ',')? ','? '}'
block: '{' stmt* '}'
stmt: block | ';' | localvar ';' | typedecl | stmtexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (localvar | stmtexpr % ',')? ';' expr? ';' (stmtexpr % ',')? ')' stmt | 'for' '(' pmod* type ID ':' expr ')' stmt | switch
  | 'try' block (catch+ finally? | finally) | 'try' '(' resource %% ';' ')' block catch* finally? | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';'
  | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | 'yield' expr ';' | ID ':' stmt
catch: 'catch' '(' pmod* type % '|' ID ')' block
finally: 'finally' block
resource: pmod* type ID '=' expr | expr
localvar: pmod* type vars
switch: 'switch' '(' expr ')' '{' group* '}'
group: label ':' stmt* | label '->' (expr ';' | block | 'throw' expr ';')
label: 'case' (caseval % ',') ('when' expr)? | 'default'
caseval: expr | pattern | 'default'
pattern: pmod* type ID | type '(' (pattern % ',')? ')' ID?
stmtexpr: operand asg expr | ('++' | '--') operand | operand ('++' | '--') | call | creation
asg: '=' | BIN
expr: link* operand | link* tail
link: operand binop
binop: BIN | '-' | '+' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '=' | '?' expr ':'
tail: prefix* lambda
lambda: (ID | '(' (ID % ',')? ')' | '(' params ')') '->' (expr | block)
operand: prefix* prim | operand ('++' | '--') | operand 'instanceof' ('final'? type | pattern)
prefix: '-' | '+' | '!' | '~' | '++' | '--' | '(' type % '&' ')'
prim: ID | lit | 'this' | 'super' | '(' expr ')' | switch | call | creation | prim '.' ID | prim '.' ('this' | 'super' | 'class') | prim '[' expr ']' | prim '::' targs? (ID | 'new') | type '::' targs? (ID | 'new') | (type | 'void') '.' 'class'
lit: NUM | STR | 'true' | 'false' | 'null'
call: prim args | prim '.' targs ID args | prim '.' targs 'super' args | targs ('this' | 'super') args
args: '(' (expr % ',')? ')'
creation: (prim '.')? 'new' targs? annot* cname targs? args body? | 'new' annot* (PRIM | cname) (annot* '[' expr ']')+ dims? | 'new' annot* (PRIM | cname) dims '{' (init %% ',')? ','? '}'
""",
)

KOTLIN = Spec(
    lexemes=r"(?P<skip>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|\A#![^\n]*)|(?P<bad>/\*)|(?P<STR>\"\"\".*?\"\"\"\"*|\"(?:[^\"\\\n$]|\\.|\$(?!\{)|\$\{(?:[^{}\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}]*\})*\})*\"|" + _CHR + rf")|(?P<RETAT>return@\w+)|(?P<JUMPAT>(?:break|continue)@\w+)|(?P<THISAT>(?:this|super)@\w+)|(?P<LABEL>[^\W\d]\w*@(?!\w))|(?P<NOTIN>!in\b|!is\b)|(?P<ASQ>as\?)|(?P<NUM>0[xX][\da-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[fFuUL]*|\.\d+[fF]?)",
    name=r"(?!as\?)[^\W\d]\w*|`[^`\n]+`",
    soft="public private protected internal open abstract final sealed data inner enum annotation companion lateinit override suspend inline noinline crossinline vararg tailrec operator infix external expect actual value const reified by catch constructor dynamic file finally get import init out set where",
    classes={"BIN": "/ % == != === !== <= >= && || ?: .. ..<", "ASG": "+= -= *= /= %="},
    layout="line", ends="ID NUM STR ) ] } ? > * ++ -- !! this super null true false break continue return RETAT JUMPAT THISAT", joins=". ?. :: ?: && || ) ] } , as ASQ : = -> { += -= *= /= == != by where",
    rules="""
file: sep? (('package' qname | 'import' qname ('.' '*' | 'as' ID)? | annot+ | stmt) % sep)? sep?
sep: (NL | ';')+
qname: ID % '.'
annot: '@' (ID ':')? (utype args? | '[' (utype args?)+ ']')
mods: (annot NL* | 'public' | 'private' | 'protected' | 'internal' | 'open' | 'abstract' | 'final' | 'sealed' | 'data' | 'inner' | 'enum' | 'annotation' | 'companion' | 'const' | 'lateinit' | 'override' | 'suspend' | 'inline' | 'noinline' | 'crossinline' | 'vararg' | 'tailrec' | 'operator' | 'infix' | 'external' | 'expect' | 'actual' | 'value' | 'reified' | 'in' | 'out')+
decl: mods? ('class' | 'fun'? 'interface') ID tparams? (mods? 'constructor')? cparams? (':' super % ',')? wheres? cbody?
  | mods? 'object' ID (':' super % ',')? cbody? | mods? 'fun' tparams? (rtype '.')? ID fparams (':' type)? wheres? fbody?
  | property | mods? 'typealias' ID tparams? '=' type
property: mods? ('val' | 'var') tparams? (rtype '.')? binding wheres? (('=' | 'by') expr)? (sep? accessor)*
binding: ID (':' type)? | '(' (annot* (ID | '_') (':' type)?) %% ',' ')'
accessor: mods? 'get' ('(' ')' (':' type)? fbody)? | mods? 'set' ('(' (mods? ID (':' type)?) ','? ')' (':' type)? fbody)?
cparams: '(' ((mods? ('val' | 'var')? ID ':' type ('=' expr)?) %% ',')? ')'
fparams: '(' ((mods? ID ':' type ('=' expr)?) %% ',')? ')'
fbody: block | '=' expr
super: annot* utype args | annot* type ('by' expr)?
tparams: '<' (mods? ID (':' type)?) %% ',' '>'
wheres: 'where' (annot* ID ':' type) % ','
cbody: '{' sep? (member % sep)? sep? '}' | '{' sep? entry %% ',' (sep (member % sep)?)? sep? '}'
entry: mods? ID args? cbody? NL?
member: decl | 'init' block | mods? 'companion' 'object' (':' super % ',')? cbody? | mods? 'constructor' fparams (':' ('this' | 'super') args)? block?
type: mods? core | type '&' type
core: utype | '(' (fntypearg %% ',')? ')' '->' type | '(' type ')' | rtype '.' '(' (fntypearg %% ',')? ')' '->' type | core '?' | 'dynamic'
fntypearg: (ID ':')? type
rtype: mods? utype '?'* | '(' type ')' '?'*
utype: (ID targs?) % '.'
targs: '<' (type | '*') %% ',' '>'
block: '{' sep? (stmt % sep)? sep? '}'
stmt: (LABEL | annot NL?)* (decl | expr | loop | operand ('=' | ASG) expr)
loop: 'for' '(' annot* forvar 'in' expr ')' NL? ctl | 'while' '(' expr ')' NL? ctl | 'while' '(' expr ')' ';' | 'do' NL? ctl? NL? 'while' '(' expr ')'
forvar: ID (':' type)? | '(' ((ID | '_') (':' type)?) %% ',' ')'
ctl: block | stmt
expr: link* operand | link* tail
link: operand binop
binop: BIN | '-' | '+' | '*' | '<' | '>' | 'in' | NOTIN | ID
tail: prefix* closed
closed: 'if' '(' expr ')' NL? ctl? ((';' | NL)? 'else' NL? ctl?)? | 'throw' expr | ('return' | RETAT) expr
prefix: '-' | '+' | '!' | '++' | '--' | LABEL | annot
operand: prefix* prim | operand ('is' | NOTIN) type | operand ('as' | ASQ) type
prim: ID | NUM | STR | '(' expr ')' | 'this' | 'super' ('<' type '>')? | THISAT | 'null' | 'true' | 'false' | '_' | lambda | 'return' | RETAT | 'break' | 'continue' | JUMPAT | '::' (ID | 'class') | '[' (expr %% ',')? ']'
  | 'fun' (rtype '.')? fparams (':' type)? fbody | mods? 'object' (':' super % ',')? cbody | when | 'try' block ((NL? catch)+ (NL? 'finally' block)? | NL? 'finally' block)
  | prim '.' (ID | 'class') | prim '?.' ID | prim '::' (ID | 'class') | core '::' (ID | 'class') | prim '[' expr %% ',' ']' | prim targs? args | prim targs? args? trailing | prim '!!' | prim '++' | prim '--' | utype
trailing: (LABEL | annot)* lambda
args: '(' (((ID '=')? '*'? expr) %% ',')? ')'
catch: 'catch' '(' annot* ID ':' type ','? ')' block
lambda: '{' ((lparam %% ',')? '->')? sep? (stmt % sep)? sep? '}'
lparam: (ID | '_') (':' type)? | '(' ((ID | '_') (':' type)?) %% ',' ')' (':' type)?
when: 'when' ('(' (annot* 'val' ID (':' type)? '=')? expr ')')? '{' sep? (whenentry % sep?)? sep? '}'
whenentry: (cond %% ',' ('if' expr)? | 'else') NL? '->' NL? ctl
cond: expr | ('in' | NOTIN) expr | ('is' | NOTIN) type
""",
)

GO = Spec(
    lexemes=_C + rf"|(?P<STR>{_DQ}|`[^`]*`|{_CHR})|(?P<NUM>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)",
    classes={"BIN": "/ % == != <= >= < > && || << >> | &^", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= &^="},
    layout="semicolon", ends="ID NUM STR break continue fallthrough return ++ -- ) ] }",
    rules="""
file: 'package' ID ';' ('import' importbody ';')* (top %% ';')?
importbody: importspec | '(' (importspec %% ';')? ')'
importspec: ('.' | ID)? STR
top: decl | 'func' receiver? ID tparams? sig block?
receiver: '(' ID? '*'? tname targs? ','? ')'
decl: 'const' (constspec | '(' (constspec %% ';')? ')') | 'var' (varspec | '(' (varspec %% ';')? ')') | 'type' (typespec | '(' (typespec %% ';')? ')')
constspec: ID % ',' (type? '=' exprs)?
varspec: ID % ',' (type ('=' exprs)? | '=' exprs)
typespec: ID tparams? '='? type
tparams: '[' (ID % ',' union) %% ',' ']'
union: ('~'? type) % '|'
sig: params (params | type)?
params: '(' (param %% ',')? ')'
param: ID? '...'? type
type: tname targs? | '*' type | plain | '(' type ')'
plain: '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' '{' (field %% ';')? '}' | 'interface' '{' (method %% ';')? '}'
tname: ID ('.' ID)?
targs: '[' type %% ',' ']'
field: ID % ',' type STR? | '*'? tname targs? STR?
method: ID sig | union
block: '{' stmts? '}'
stmts: (stmt? ';')* stmt | (stmt? ';')+
stmt: decl | ID ':' stmt? | simple | ('go' | 'defer') expr | 'return' exprs? | ('break' | 'continue') ID? | 'goto' ID | 'fallthrough' | block | if | 'switch' (simple? ';')? simple? '{' clause* '}' | 'select' '{' clause* '}' | 'for' forhead? block
forhead: expr | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr
if: 'if' (simple? ';')? simple block ('else' (if | block))?
clause: ('case' (exprs | simple) | 'default') ':' stmts?
simple: expr | expr '++' | expr '--' | exprs (ASG | '=' | ':=') exprs
exprs: expr % ','
expr: operand % binop
binop: BIN | '-' | '+' | '*' | '&' | '^' | '<-'
operand: ('-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~')* prim
prim: ID | NUM | STR | '(' expr ')' | 'func' sig block | plain | prim '.' ID | prim '.' '(' (type | 'type') ')' | prim '[' expr %% ',' ']' | prim '[' expr? ':' expr? (':' expr)? ']' | prim '(' (expr % ',' '...'? ','?)? ')' | prim '{' (element %% ',')? '}'
element: (value ':')? value
value: expr | '{' (element %% ',')? '}'
""",
)

CPP = Spec(
    lexemes=r"(?P<skip>//(?:\\\n|[^\n])*|/\*.*?\*/)|(?P<bad>/\*)|(?P<pp>\#(?:\\\n|/\*.*?\*/|[^\n])*)|(?P<STR>(?:u8|[uUL])?R\"(?P<h>[^()\\\s]{0,16})\(.*?\)(?P=h)\"|(?:u8|[uUL])?" + _DQ + rf"|(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n])+')|(?P<NUM>(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)\w*)",
    soft="override final import module",
    shapes={"MACRO": r"_*[A-Z][A-Z\d]*_[A-Z\d_]+"},
    classes={"BIN": "/ % ^ == != <= >= <=> += -= *= /= %= ^= &= |= <<= >>= || << | .* ->* and or xor bitand bitor not_eq and_eq or_eq xor_eq", "BUILTIN": "int long short char float double bool void signed unsigned wchar_t char8_t char16_t char32_t __int128"},
    rules="""
file: top*
top: ';' | attr+ | attr* decl | 'template' '<' (tparam % ',')? '>' requires? top | 'template' top | 'extern' 'template' top | 'export' top | attr* 'inline'? 'namespace' attr* nsname? attr* '{' top* '}' | 'namespace' ID '=' name ';' | 'extern' STR ('{' top* '}' | top) | 'export'? ('import' | 'module') ID ('.' ID)* ';' | 'concept' ID '=' expr ';'
nsname: (('inline')? ID) % '::'
attr: MACRO ('(' attrtok* ')')? | '[' '[' attrtok* ']' ']' | 'alignas' '(' (expr | type) ')' | '__attribute__' '(' attrtok* ')'
attrtok: '(' attrtok* ')' | '[' attrtok* ']' | '{' attrtok* '}' | ANY
decl: 'using' ('typename'? name '...'?) % ',' ';' | 'using' 'namespace' name ';' | 'using' 'enum' name ';' | 'using' ID attr* '=' type ';' | 'static_assert' '(' expr (',' expr)? ')' ';' | 'asm' 'volatile'? '(' attrtok* ')' ';'
  | specs ';' | specs initdecl % ',' ';' | (specs | spec+)? function | 'typedef' specs declarator % ',' ';' | 'friend' (specs initdecl % ',' ';' | specs ';' | (specs | spec+)? function)
specs: spec* core spec*
spec: 'static' | 'const' | 'constexpr' | 'consteval' | 'constinit' | 'inline' | 'extern' | 'virtual' | 'explicit' | 'explicit' '(' expr ')' | 'mutable' | 'volatile' | 'register' | 'thread_local' | attr
core: BUILTIN+ | 'typename'? name | 'auto' | name 'auto' | 'decltype' '(' (expr | 'auto') ')' | classkey attr* name | 'enum' name | classdef | enumdef
classkey: 'class' | 'struct' | 'union'
classdef: classkey attr* (name 'final'?)? (':' base % ',')? '{' member* '}'
base: attr* ('virtual' | 'public' | 'private' | 'protected')* ('typename'? name | 'decltype' '(' expr ')') '...'?
enumdef: 'enum' ('class' | 'struct')? attr* name? (':' specs)? '{' ((ID attr* ('=' expr)?) %% ',')? '}' | 'enum' ('class' | 'struct') name (':' specs)? | 'enum' name ':' specs
member: ('public' | 'private' | 'protected') ':' | attr+ | attr* decl | ';' | 'template' '<' (tparam % ',')? '>' requires? member | attr* specs (declarator? ':' expr ('=' expr)?) % ',' ';' | (specs | spec+)? funcdecl ';'
name: '::'? seg % '::'
seg: ID | ID targs | 'template' ID targs | '~' ID | operatorname | 'decltype' '(' expr ')'
operatorname: 'operator' (opsign | specs ptr*) | 'operator' STR ID?
opsign: BIN | '-' | '+' | '*' | '&' | '&&' | '<' | '>' | '>' '>' | '=' | '!' | '~' | '++' | '--' | '->' | ',' | '(' ')' | '[' ']' | ('new' | 'delete') ('[' ']')? | 'co_await' | 'not' | 'compl'
targs: '<' (targ % ',')? '>'
targ: (type | expr) '...'?
type: specs abstract?
abstract: ptr+ | ptr* abscore
abscore: '(' ptr+ ')' suffix* | suffix+ | '(' ptr* ')' suffix+ | '...'
ptr: ('*' | '&' | '&&') cv* | name '::' '*' cv*
cv: 'const' | 'volatile' | attr | '__restrict'
declarator: ptr* dcore suffix*
dcore: '...'? name attr* | '(' declarator ')'
suffix: '(' params? ')' quals? | '[' expr? ']'
quals: (qual)+
qual: 'const' | 'volatile' | '&' | '&&' | 'noexcept' | 'noexcept' '(' expr ')' | 'throw' '(' (type % ',')? ')' | 'override' | 'final' | '->' type | attr | requires
params: param % ',' (',' '...')? | param % ',' '...' | '...'
param: attr* 'this'? specs (declarator | abstract)? ('=' init)?
tparam: ('typename' | 'class') '...'? ID? ('=' type)? | 'template' '<' (tparam % ',')? '>' ('typename' | 'class') '...'? ID? ('=' name)? | param
requires: 'requires' expr
initdecl: declarator requires? initializer? | '[' ID % ',' ']' initializer | ('&' | '&&') '[' ID % ',' ']' initializer
initializer: '=' init | braces | '(' exprs ')'
init: expr | braces
braces: '{' (element %% ',')? '}'
element: ('.' ID)+ ('=' init | braces) | init '...'? | ('[' expr ']')+ '=' init
funcdecl: declarator requires? ('=' (NUM | 'default' | 'delete'))?
function: declarator requires? (':' meminit % ',')? block | declarator requires? 'try' (':' meminit % ',')? block catch+ | declarator '=' ('default' | 'delete') ';' | declarator ';'
meminit: name ('(' exprs? ')' | braces) '...'?
block: '{' stmt* '}'
stmt: block | ';' | attr+ ';'? | attr* decl | attr* exprs ';' | 'if' 'constexpr'? cond stmt ('else' stmt)? | 'if' '!'? 'consteval' block ('else' stmt)? | 'while' cond stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' forinit exprs? ';' exprs? ')' stmt | 'for' '(' forinit? attr* specs (declarator | ptr* '[' ID % ',' ']') ':' init ')' stmt
  | 'switch' cond stmt | 'case' expr ('...' expr)? ':' stmt? | 'default' ':' stmt? | ID ':' stmt? | 'try' block catch+ | ('return' | 'co_return') (exprs | braces)? ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' | 'co_yield' expr ';'
cond: '(' forinit? (exprs | specs declarator initializer) ')'
forinit: ';' | exprs ';' | specs initdecl % ',' ';' | 'using' ID '=' type ';'
catch: 'catch' '(' ('...' | param) ')' block
exprs: (expr '...'? | braces) % ','
expr: link* operand | link* tail | link braces | link* link braces
link: operand binop
binop: BIN | '-' | '+' | '*' | '&' | '&&' | '<' | '>' | '>' '>' | '=' | '?' exprs? ':' | '...' BIN | '...' '+' | '...' '&&' | '...' ','
tail: prefix* 'throw' expr? | 'co_yield' (expr | braces) | prefix* 'co_await' expr
operand: prefix* prim | '...'
prefix: '-' | '+' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'not' | 'compl' | 'sizeof' | 'co_await' | '(' type ')' | 'alignof'
prim: name | NUM | STR+ (ID STR)* | 'this' | 'true' | 'false' | 'nullptr' | '(' exprs ')' | lambda | ('sizeof' | 'alignof' | 'typeid' | 'noexcept') '(' (type | exprs) ')' | 'sizeof' '...' '(' ID ')' | castword '<' type '>' '(' exprs ')' | (BUILTIN | 'typename' name | 'auto' | 'decltype' '(' expr ')') ('(' exprs? ')' | braces) | BUILTIN BUILTIN+ '(' exprs? ')' | new | '::'? 'delete' ('[' ']')? operand
  | prim '.' 'template'? name | prim '->' 'template'? name | prim '(' exprs? ')' | prim '[' exprs? ']' | prim '++' | prim '--' | name braces | 'requires' ('(' params? ')')? '{' req* '}'
req: expr ';' | 'typename' name ';' | '{' expr '}' 'noexcept'? ('->' type)? ';' | 'requires' expr ';'
castword: 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast'
new: '::'? 'new' ('(' exprs ')')? (specs ptr* ('[' expr? ']')* | '(' type ')') ('(' exprs? ')' | braces)?
lambda: '[' (capture % ',')? ']' ('<' (tparam % ',')? '>' requires?)? attr* ('(' params? ')')? ('mutable' | 'constexpr' | 'consteval' | 'static')* quals? block
capture: '=' | '&' | '&'? '...'? ID ('...' | initializer)? | '*'? 'this'
""",
)

CSHARP = Spec(
    lexemes=_C + rf"|(?P<pp>\#[ \t]*(?:if|elif|else|endif|define|undef|warning|error|line|region|endregion|pragma|nullable)\b[^\n]*|\#[!:][^\n]*)|(?P<STR>[$@]*@[$@]*\"(?:[^\"]|\"\")*\"|\$*\"\"\"+.*?\"\"\"+|\$\"(?:[^\"\\\n{{]|\\.|\{{\{{|\{{(?:[^{{}}\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\{{[^{{}}]*\}})*\}})*\"|{_DQ}(?:u8)?|{_CHR})|(?P<NUM>0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)",
    name=r"@?[^\W\d]\w*",
    soft="get set init add remove value var async await where partial record from select orderby join let group into on equals by ascending descending yield when and or not with dynamic nameof scoped required file global unmanaged notnull alias managed args field nint nuint",
    classes={"BIN": "/ % == != <= && || << ^ | ??", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= >>>= ??=", "PRIM": "int long short byte char float double bool string object decimal uint ulong ushort sbyte"},
    rules="""
file: ('extern' 'alias' ID ';')* using* globalattr* top*
using: 'global'? 'using' 'static'? 'unsafe'? (ID '=')? type ';'
globalattr: '[' ID ':' attr %% ',' ']'
top: namespace | typedecl | stmt
namespace: attrs? 'namespace' qname (';' | '{' using* (namespace | typedecl)* '}' ';'?)
qname: ID % '.'
attrs: ('[' ((ID | 'return' | 'event') ':')? attr %% ',' ']')+
attr: tname ('(' (attrarg % ',')? ')')?
attrarg: (ID ('=' | ':'))? expr
mods: ('public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'const' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'async' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'partial' | 'required' | 'ref' | 'file' | 'fixed')+
typedecl: attrs? mods? ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID tparams? ('(' params? ')')? (':' base % ',')? constraint* ('{' member* '}' ';'? | ';')
  | attrs? mods? 'enum' ID (':' type)? '{' ((attrs? ID ('=' expr)?) %% ',')? '}' ';'?
  | attrs? mods? 'delegate' 'ref'? result ID tparams? '(' params? ')' constraint* ';'
base: type args?
constraint: 'where' ID ':' (type | 'class' '?'? | 'struct' | 'notnull' | 'unmanaged' | 'new' '(' ')' | 'default') % ','
tparams: '<' (attrs? ('in' | 'out')? ID) % ',' '>'
member: typedecl | attrs? mods? type (ID ('[' expr ']')? ('=' init)?) % ',' ';' | attrs? mods? result ename tparams? '(' params? ')' constraint* mbody | attrs? mods? ID '(' params? ')' (':' ('base' | 'this') args)? mbody | attrs? mods? '~' ID '(' ')' mbody
  | attrs? mods? type ename propbody | attrs? mods? type (tname '.')? 'this' '[' params ']' propbody | attrs? mods? 'event' type (ID ('=' expr)?) % ',' ';' | attrs? mods? 'event' type ename '{' accessor+ '}'
  | attrs? mods? type (tname '.')? 'operator' 'checked'? opsign '(' params ')' mbody | attrs? mods? ('implicit' | 'explicit') (tname '.')? 'operator' 'checked'? type '(' params ')' mbody
opsign: BIN | '-' | '+' | '*' | '&' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | '!' | '~' | '++' | '--' | 'true' | 'false'
mbody: block | '=>' expr ';' | ';'
propbody: '{' accessor+ '}' ('=' init ';')? | '=>' expr ';'
accessor: attrs? mods? ('get' | 'set' | 'init' | 'add' | 'remove') mbody
result: type | 'void'
ename: (ID targs? '.')* ID
params: param % ','
param: attrs? ('ref' | 'out' | 'in' | 'params' | 'this' | 'scoped' | 'readonly')* type ID ('=' expr)? | '__arglist'
type: (PRIM | tname | '(' (type ID?) % ',' ')' | 'void' '*' | 'delegate' '*' ('managed' | 'unmanaged')? '<' result % ',' '>') tsuffix* | 'ref' 'readonly'? type
tsuffix: '?' | '*' | '[' ','* ']'
tname: ((ID '::')? ID targs?) % '.'
targs: '<' type % ',' '>' | '<' ','* '>'
block: '{' stmt* '}'
stmt: block | ';' | 'const'? 'ref'? type (ID ('=' init)?) % ',' ';' | ('scoped' | 'await')? 'using' type (ID '=' expr) % ',' ';' | attrs? mods? result ID tparams? '(' params? ')' constraint* mbody | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (type (ID ('=' init)?) % ',' | expr % ',')? ';' expr? ';' (expr % ',')? ')' stmt | 'await'? 'foreach' '(' (type ID | expr) 'in' expr ')' stmt | 'switch' expr '{' (label+ stmt+)* '}' | 'try' block (catch+ ('finally' block)? | 'finally' block)
  | 'return' expr? ';' | 'throw' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (ID | 'case' expr | 'default') ';' | 'lock' '(' expr ')' stmt | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' type (ID '=' expr) % ',' ')' stmt | 'await'? 'using' '(' (type (ID '=' expr) % ',' | expr) ')' stmt | 'yield' ('return' expr | 'break') ';' | ID ':' stmt
label: 'case' pattern ('when' expr)? ':' | 'default' ':'
catch: 'catch' ('(' type ID? ')')? ('when' '(' expr ')')? block
init: expr | braces
braces: '{' (element %% ',')? '}'
element: (ID | '[' expr % ',' ']') '=' (expr | braces) | expr | braces
expr: link* operand | link* tail | link* operand '..'
link: operand binop
binop: BIN | '-' | '+' | '*' | '&' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | '=' | ASG | '?' expr ':' | '..'
tail: prefix* lambda | 'throw' expr | query | '..'
lambda: attrs? ('async' | 'static')* result? (ID | '(' (lparam % ',')? ')') '=>' (expr | block) | ('async' | 'static')* 'delegate' ('(' params? ')')? block
lparam: attrs? ('ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type? ID ('=' expr)?
query: 'from' type? ID 'in' expr clause* ('select' expr | 'group' expr 'by' expr) ('into' ID clause* ('select' expr | 'group' expr 'by' expr))*
clause: 'from' type? ID 'in' expr | 'let' ID '=' expr | 'where' expr | 'join' type? ID 'in' expr 'on' expr 'equals' expr ('into' ID)? | 'orderby' (expr ('ascending' | 'descending')?) % ','
operand: prefix* prim | operand 'is' pattern | operand 'as' type | operand 'switch' '{' ((pattern ('when' expr)? '=>' expr) %% ',')? '}' | operand 'with' braces
prefix: '-' | '+' | '!' | '~' | '++' | '--' | '^' | '&' | '*' | 'await' | '(' type ')' | 'ref' | '..'
pattern: patone % ('and' | 'or')
patone: 'not'* patatom
patatom: expr | type ID | 'var' (ID | '(' (ID % ',')? ')') | ('<' | '>' | '<=' | '>=') operand | type? '{' ((ename ':' pattern) %% ',')? '}' ID? | type? '(' (((ID ':')? pattern) % ',')? ')' ('{' ((ename ':' pattern) %% ',')? '}')? ID? | '[' ((pattern | '..' pattern?) %% ',')? ']' ID? | '(' pattern ')' | type
prim: ID targs? | PRIM | lit | 'this' | 'base' | '(' expr ')' | '(' ((ID ':')? argval) % ',' ')' | '[' ((expr | '..' expr) %% ',')? ']' | 'new' tname? PRIM? args braces? | 'new' (tname | PRIM) braces | 'new' ((PRIM | tname | '(' (type ID?) % ',' ')') ('?' | '*')*)? '[' (expr % ',' | ','*) ']' ('[' ','* ']' | '?')* braces? | 'new' braces | ('typeof' | 'sizeof' | 'default') '(' (result | '(' (type ID?) % ',' ')') ')' | 'default' | ('checked' | 'unchecked') '(' expr ')' | 'stackalloc' (type? '[' expr? ']') braces? | ID '::' ID
  | prim ('.' | '->' | '?' '.') ID targs? | prim '?'? '[' (((ID ':')? argval) % ',') ']' | prim args | prim '++' | prim '--' | prim '!'
args: '(' (((ID ':')? argval) % ',')? ')'
argval: ('ref' | 'out' | 'in')? expr | ('out' | 'ref' | 'in') type ID | type ID
lit: NUM | STR | 'true' | 'false' | 'null'
""",
)

TYPESCRIPT = Spec(
    lexemes=r"(?P<skip>//[^\n]*|/\*.*?\*/|\A#![^\n]*|<!--[^\n]*)|(?P<bad>/\*)|(?P<STR>" + _DQ + r"|'(?:[^'\\\n]|\\.)*')|(?P<TPL>`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^`{}]|\{[^{}]*\}|`(?:[^`\\]|\\.)*`)*\})*`)|(?P<PRIV>\#[A-Za-z_$][\w$]*)|(?P<NUM>0[xX][\da-fA-F_]+n?|0[bBoO][\d_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)",
    name=r"(?:[^\W\d]|\$)[\w$]*",
    soft="abstract as assert asserts accessor async await constructor declare from get global infer is keyof let module namespace never of override private protected public readonly require satisfies set static type undefined unique using yield any unknown string number boolean symbol object bigint out defer implements interface package",
    classes={"BIN": "% ^ == != === !== <= >= && || ?? << ** |", "ASG": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="},
    layout="offence", value="ID NUM STR TPL REGEX PRIV ) ] } this super null true false ++ --", pattern=r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", markup=True,
    rules="""
file: item*
item: 'import' STR withs? ';' | 'import' ('type' | 'defer')? clause 'from' STR withs? ';' | 'export'? 'import' 'type'? ID '=' ('require' '(' STR ')' | qname) ';' | export | stmt
withs: ('with' | 'assert') object
clause: ID (',' (star | named))? | star | named
star: '*' 'as' ID
named: '{' (('type'? name ('as' name)?) %% ',')? '}'
name: WORD | STR
export: deco* 'export' decl | 'export' 'default' (expr ';' | 'abstract'? class | fn | 'interface' interface) | deco+ 'export' 'default' class | 'export' 'type'? '*' ('as' name)? 'from' STR withs? ';' | 'export' 'type'? named ('from' STR withs?)? ';' | 'export' '=' expr ';' | 'export' 'as' 'namespace' ID ';'
deco: '@' prim
decl: 'declare'? (vars ';' | fn | deco* 'abstract'? class | 'interface' interface | 'type' ID tparams? '=' type ';' | 'const'? 'enum' ID '{' ((key ('=' assign)?) %% ',')? '}' | ('namespace' | 'module') (qname | STR) ('{' item* '}' | ';') | 'global' '{' item* '}')
qname: WORD % '.'
vars: ('var' | 'let' | 'const' | 'await'? 'using') (binding '!'? (':' type)? ('=' assign)?) % ','
binding: ID | '{' (bprop %% ',')? '}' | '[' belem? (',' belem?)* ']'
belem: '...'? binding ('=' assign)?
bprop: key ':' binding ('=' assign)? | ID ('=' assign)? | '...' ID
fn: 'async'? 'function' '*'? ID? tparams? params rtype? (block | ';')
params: '(' (param %% ',')? ')'
param: deco* ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? binding '?'? (':' type)? ('=' assign)? | 'this' ':' type
rtype: ':' (type | predicate)
predicate: 'asserts'? (ID | 'this') 'is' type | 'asserts' (ID | 'this')
class: 'class' ID? tparams? ('extends' prim targs?)? ('implements' (qname targs?) % ',')? '{' member* '}'
member: ';' | deco* mod* mkey ('?' | '!')? tparams? params rtype? (block | ';') | deco* mod* mkey ('?' | '!')? (':' type)? ('=' assign)? ';' | mod* index ';' | 'static' block
mod: 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor' | 'get' | 'set' | '*'
mkey: WORD | STR | NUM | PRIV | '[' expr ']'
key: WORD | STR | NUM | '[' expr ']'
index: '[' ID ':' type ']' ':' type
interface: ID tparams? ('extends' (qname targs?) % ',')? objtype
objtype: '{' ((tmember | ) (';' | ','))* tmember? '}'
tmember: ('new')? tparams? params rtype? | ('readonly' | 'get' | 'set')* key '?'? (tparams? params rtype? | ':' type)? | 'readonly'? index | ('+' | '-')? 'readonly'? '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?
tparams: '<' (('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?) %% ',' '>'
type: union | union 'extends' type '?' type ':' type | fntype | 'asserts'? (ID | 'this') 'is' type
union: ('|' | '&')? tpost % ('|' | '&') | ('|' | '&')? (tpost ('|' | '&'))+ fntype
fntype: tparams? params '=>' (type | predicate) | 'abstract'? 'new' tparams? params '=>' type
tpost: tprim | tpost '[' type? ']'
tprim: qname targs? | 'typeof' (qname | 'import' '(' STR ')' ('.' WORD)*) targs? | STR | '-'? NUM | TPL | '(' type ')' | '[' (((('...')? WORD '?'? ':')? '...'? type '?'?) %% ',')? ']' | objtype | ('keyof' | 'unique' | 'readonly') tpost | 'infer' ID ('extends' union)? | 'import' '(' STR (',' object)? ')' ('.' WORD)* targs?
targs: '<' type %% ',' '>'
block: '{' stmt* '}'
stmt: block | ';' | decl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' '(' (vars | expr)? ';' expr? ';' expr? ')' stmt | 'for' 'await'? '(' (('var' | 'let' | 'const' | 'using') binding (':' type)? | prim) ('in' | 'of') expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'
  | 'try' block (catch ('finally' block)? | 'finally' block) | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ID? ';' | ID ':' stmt | 'debugger' ';' | 'with' '(' expr ')' stmt
catch: 'catch' ('(' binding (':' type)? ')')? block
expr: assign % ','
assign: link* operand | link* tail
link: operand binop
binop: BIN | '-' | '+' | '*' | '/' | '&' | '<' | '>' | '>' '>' | '>' '>' '>' | '=' | ASG | '?' assign ':' | 'in' | 'instanceof'
tail: prefix* arrow | 'yield' '*'? assign?
arrow: 'async'? (ID | tparams? params rtype?) '=>' (assign | block)
operand: prefix* prim | operand ('as' | 'satisfies') ('const' | type)
prefix: '-' | '+' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | '<' ('const' | type) '>'
prim: ID | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | object | 'async'? 'function' '*'? ID? tparams? params rtype? block | deco* class | 'new' prim | 'new' '.' ID | 'import' args | 'import' '.' ID | element | PRIV
  | prim ('.' | '?.') (WORD | PRIV) | prim '?.'? '[' expr ']' | prim '?.'? targs? args | prim TPL | prim '!' | prim targs | prim '++' | prim '--'
args: '(' (('...'? assign) %% ',')? ')'
array: '[' ('...'? assign)? (',' ('...'? assign)?)* ']'
object: '{' (prop %% ',')? '}'
prop: key ':' assign | ID ('=' assign)? | '...' assign | ('async' | 'get' | 'set' | '*')* key tparams? params rtype? block
element: TAG attribute* (SELFCLOSE | TAGEND child* CLOSE)
attribute: ATTR ('=' (STR | '{' assign '}' | element))? | '{' '...' assign '}'
child: TEXT | '{' '}' | '{' '...'? expr '}' | element
""",
)

PYTHON = Spec(
    lexemes=r"(?P<skip>\#[^\n]*)|(?P<join>\\\n)|(?P<STR>(?:[fFtT][rR]?|[rR][fFtT])(?:\"(?!\"\")(?:[^\"\\\n{]|\\.|\{\{|\{(?:[^{}\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}\n]*\})*\})*\"|'(?!'')(?:[^'\\\n{]|\\.|\{\{|\{(?:[^{}'\n]|'(?:[^'\\\n]|\\.)*'|\{[^{}\n]*\})*\})*')|(?:[rRbBuU]{0,2}|[fFtT][rR]?|[rR][fFtT])(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<NUM>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])|(?P<bad>\d\w*)",
    soft="match case type _",
    classes={"BIN": "/ // % @ ^ & | << >> < > <= >= == !=", "ASG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **="},
    layout="indent",
    rules="""
file: stmt*
stmt: simple %% ';' NEWLINE | compound
simple: stars | annotated | target '=' chain | target ASG (yield | stars) | 'return' stars? | 'import' (dotted ('as' ID)?) % ',' | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported % ',' | '(' imported %% ',' ')') | 'pass' | 'break' | 'continue' | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') ID % ',' | 'del' stars | 'assert' test (',' test)? | 'type' ID tparams? '=' test | yield
imported: ID ('as' ID)?
dotted: ID % '.'
annotated: (ID | prim '.' ID | prim '[' subs ']' | '(' (ID | prim '.' ID | prim '[' subs ']') ')') ':' test ('=' (yield | stars))?
target: ref | starred
starred: ref_or_star %% ','
ref_or_star: ref | '*' ref
ref: ID | prim '.' ID | prim '[' subs ']' | '(' (ref_or_star %% ',')? ')' | '[' (ref_or_star %% ',')? ']'
chain: (target '=')* (yield | stars)
yield: 'yield' ('from' test | stars)?
stars: (test | '*' operands) %% ','
compound: 'if' named block ('elif' named block)* else? | 'while' named block else? | 'async'? 'for' target 'in' stars block else? | 'try' block (except+ else? ('finally' block)? | 'finally' block) | 'async'? 'with' withs block | decorators? def | decorators? 'class' ID tparams? ('(' (arg %% ',')? ')')? block | 'match' (namedstar %% ',') ':' NEWLINE INDENT ('case' patterns ('if' named)? block)+ DEDENT
else: 'else' block
except: 'except' '*'? (test ('as' ID)? | test (',' test)+)? block
withs: (test ('as' target_one)?) % ',' | '(' (test ('as' target_one)?) %% ',' ')'
target_one: ref
decorators: ('@' named NEWLINE)+
def: 'async'? 'def' ID tparams? '(' params? ')' ('->' test)? block
tparams: '[' (('*' | '**')? ID (':' test)? ('=' (test | '*' operands))?) %% ',' ']'
params: param %% ','
param: ID (':' (test | '*' operands))? ('=' test)? | '*' (ID (':' (test | '*' operands))?)? | '**' ID (':' test)? | '/'
block: ':' simple %% ';' NEWLINE | ':' NEWLINE INDENT stmt+ DEDENT
named: test | ID ':=' test
namedstar: named | '*' operands
test: ors | ors 'if' ors 'else' test | lambda
lambda: 'lambda' (lparam %% ',')? ':' test
lparam: ID ('=' test)? | '*' ID? | '**' ID | '/'
ors: nots % ('and' | 'or')
nots: 'not'* compare
compare: operands % cmp
cmp: 'in' | 'not' 'in' | 'is' | 'is' 'not'
operands: ('-' | '+' | '~')* power
  | operands (BIN | '-' | '+' | '*') ('-' | '+' | '~')* power
power: 'await'? prim ('**' ('-' | '+' | '~')* power)?
prim: ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (namedstar %% ',')? ')' | '(' yield ')' | '(' namedstar comp+ ')' | '[' (namedstar %% ',')? ']' | '[' namedstar comp+ ']' | '{' ((test ':' test | '**' operands) %% ',')? '}' | '{' test ':' test comp+ '}' | '{' namedstar %% ',' '}' | '{' namedstar comp+ '}' | prim '.' ID | prim '(' (arg %% ',')? ')' | prim '[' subs ']'
arg: named | ID '=' test | '*' test | '**' test | named comp+
comp: 'async'? 'for' target 'in' ors ('if' (ors | lambda | ID ':=' ors))*
subs: (named | '*' operands | test? ':' test? (':' test?)?) %% ','
patterns: (pat | '*' ID) %% ','
pat: patone % '|' ('as' ID)?
patone: ID | ('-')? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | '(' ((pat | '*' ID) %% ',')? ')' | '[' ((pat | '*' ID) %% ',')? ']' | '{' (((dotted | ('-')? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False') ':' pat | '**' ID) %% ',')? '}' | dotted '(' ((pat | ID '=' pat) %% ',')? ')'
""",
)

LUA = Spec(
    lexemes=r"(?P<skip>--\[(?P<h>=*)\[.*?\](?P=h)\]|--(?!\[=*\[)[^\n]*|\A#[^\n]*)|(?P<bad>--\[=*\[)|(?P<STR>\"(?:[^\"\\\n]|\\z\s*|\\.)*\"|'(?:[^'\\\n]|\\z\s*|\\.)*'|\[(?P<g>=*)\[.*?\](?P=g)\])|(?P<NUM>0[xX][\da-fA-F]*\.?[\da-fA-F]*(?:[pP][+-]?\d+)?[uUlLiI]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLiI]*)",
    classes={"BIN": "+ * / // % ^ .. == ~= <= >= < > & | << >>"},
    rules="""
file: chunk
chunk: stmt* ('return' exprs? ';'?)?
stmt: ';' | prefixed % ',' '=' exprs | call | '::' ID '::' | 'break' | 'goto' ID | 'do' chunk 'end' | 'while' expr 'do' chunk 'end' | 'repeat' chunk 'until' expr | 'if' expr 'then' chunk ('elseif' expr 'then' chunk)* ('else' chunk)? 'end' | 'for' ID '=' expr ',' expr (',' expr)? 'do' chunk 'end' | 'for' ID % ',' 'in' exprs 'do' chunk 'end' | 'function' ID ('.' ID)* (':' ID)? body | 'local' 'function' ID body | 'local' (ID ('<' ID '>')?) % ',' ('=' exprs)?
exprs: expr % ','
expr: operand % binop
binop: BIN | '-' | '~' | 'and' | 'or'
operand: ('-' | 'not' | '#' | '~')* value
value: NUM | STR | 'nil' | 'true' | 'false' | '...' | 'function' body | table | prefixed | call | '(' expr ')'
prefixed: ID | (prefixed | call | '(' expr ')') ('[' expr ']' | '.' ID)
call: (prefixed | call | '(' expr ')') (':' ID)? (args | STR | table)
args: '(' exprs? ')'
body: '(' (ID % ',' (',' '...')? | '...')? ')' chunk 'end'
table: '{' (element %% (',' | ';'))? '}'
element: '[' expr ']' '=' expr | ID '=' expr | expr
""",
)

SPECS = {"rust": RUST, "java": JAVA, "csharp": CSHARP, "cpp": CPP, "go": GO, "kotlin": KOTLIN, "typescript": TYPESCRIPT, "python": PYTHON, "lua": LUA}
