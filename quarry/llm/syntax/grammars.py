"""Grammars of the languages over the kinds of lexers.tokens, written from the languages' public references.

They follow the statement and expression structure; what only the meaning of names decides is left open. No rule
is left-recursive and no starred body is nullable.
"""

from __future__ import annotations

from functools import cache

from quarry.llm.syntax.derivatives import Grammar
from quarry.llm.syntax.lexers import WORDS

_JS = """
prog: stmt* [tail]
block: '{' stmt* [tail] '}'
tail: simple | 'if' '(' expr ')' [stmt 'else'] tail | 'for' ['await'] '(' forhead ')' tail | 'while' '(' expr ')' tail | ident ':' tail
ident: ID | 'of' | 'get' | 'set' | 'from' | 'as' | 'async' | 'static' | 'let' | 'await' | 'yield' | TSIDENT
simple: 'return' [expr] | 'throw' expr | 'break' [ident] | 'continue' [ident] | 'debugger' | vars | exprstmt | 'do' stmt 'while' '(' expr ')' | importdecl | exportsimple | TSSIMPLE
exprstmt: !('{' 'function' 'class' 'async') expr | 'async' !('function') asynctail
asynctail: (ident | params [TYPEANN]) '=>' (block | asg) | trailer* [binrest] | binrest
binrest: asgop asg | (binop un)+
stmt: simple ';' | ';' | block [';'] | 'if' '(' expr ')' stmt ['else' stmt] | 'for' ['await'] '(' forhead ')' stmt | 'while' '(' expr ')' stmt
  | 'try' block (catch [finally] | finally) [';'] | 'switch' '(' expr ')' '{' case* '}' [';'] | func [';'] | class [';'] | ident ':' stmt | exportdecl [';'] | 'do' block 'while' '(' expr ')' | TSSTMT
catch: 'catch' ['(' binding [TYPEANN] ')'] block
finally: 'finally' block
case: ('case' expr | 'default') ':' stmt* [tail]
forhead: [forinit] ';' [expr] ';' [expr] | fordecl ('of' asg | 'in' expr)
fordecl: ('const' | 'let' | 'var') binding | post
forinit: vars | expr
vars: ('const' | 'let' | 'var') declarator (',' declarator)*
declarator: binding ['!'] [TYPEANN] ['=' asg]
importdecl: 'import' (STR | ['type'] importclause 'from' STR) ['with' object]
importclause: ident [',' (nsimport | named)] | nsimport | named
nsimport: '*' 'as' ident
named: '{' [spec (',' spec)* [',']] '}'
spec: ['type'] (anyname | STR) ['as' (anyname | STR)]
exportsimple: 'export' (vars | ['type'] named ['from' STR] | '*' ['as' anyname] 'from' STR | 'default' !('function' 'class' 'async') asg | TSEXPORTSIMPLE)
exportdecl: 'export' ['default'] (func | class | TSDECL) | 'export' 'default' 'async' asynctail ';'
func: ['async'] 'function' ['*'] [ident] TPARAMS params [TYPEANN] (block | TSNOBODY)
params: '(' [param (',' param)* [',']] ')'
param: DECOR TSMOD ['...'] (binding | 'this') ['?'] [TYPEANN] ['=' asg]
binding: ident | '{' [bindprop (',' bindprop)* [',']] '}' | '[' [[bindelem] (',' [bindelem])*] ']'
bindprop: '...' ident | propkey ':' bindelem | ident ['=' asg]
bindelem: ['...'] binding ['=' asg]
class: DECOR [TSABSTRACT] 'class' [ident] TPARAMS ['extends' post [TARGS]] [TSIMPL] '{' member* '}'
member: ';' | DECOR membermod* (propkey TPARAMS params [TYPEANN] (block | TSNOBODY) | propkey ['?' | '!'] [TYPEANN] ['=' asg] ';' | '*' propkey params [TYPEANN] block | 'static' block TSINDEX)
membermod: 'static' | 'async' | 'get' | 'set' TSMODS
propkey: anyname | STR | NUM | '[' asg ']'
expr: asg (',' asg)*
asg: arrow | cond [asgop asg] | 'yield' ['*'] [asg]
asgop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>' '=' | '>>>='
arrow: ['async'] (ident | TPARAMS params [TYPEANN]) '=>' (block | asg)
cond: bin ['?' asg ':' asg]
bin: un (binop un)* 
binop: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '===' | '!=' | '!==' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '&&' | '||' | '??' | '&' | '|' | '^' | 'instanceof' | 'in'
un: ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* post ASTYPE
post: prim trailer* ['++' | '--']
trailer: '.' anyname | '?.' (anyname | args | '[' expr ']') | args | '[' expr ']' | TPL TSBANG
args: '(' [arg (',' arg)* [',']] ')'
arg: ['...'] asg
prim: ident | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | object | func | class | 'new' newtail | 'import' (args | '.' anyname)
newtail: '.' anyname | prim ('.' anyname | '[' expr ']')* [TARGS] [args] | 'new' newtail
array: '[' [arg] (',' [arg])* ']'
object: '{' [prop (',' prop)* [',']] '}'
prop: '...' asg | propkey ':' asg | ident ['=' asg] | propmod* propkey TPARAMS params [TYPEANN] block
propmod: 'get' | 'set' | 'async' | '*'
decorator: AT trailer*
"""
_TS_TYPES = """
typeann: ':' ['asserts'] type
type: ['new' | 'abstract' 'new'] functype | uniontype ['extends' uniontype '?' type ':' type] | (ident | 'this') 'is' type
functype: TPARAMS params '=>' type
uniontype: ['|' | '&'] posttype (('|' | '&') posttype)*
posttype: ('keyof' | 'readonly' | 'unique' | 'infer')* primtype ('[' [type] ']')*
primtype: ident ('.' anyname)* [targs] | 'void' | 'null' | 'this' | 'true' | 'false' | ['-'] NUM | STR | TPL | '(' type ')' | '[' [['...'] [ident ['?'] ':'] type ['?'] (',' ['...'] [ident ['?'] ':'] type ['?'])* [',']] ']' | '{' typemember* [tmbody] '}' | 'typeof' ident ('.' anyname)* | 'import' '(' STR ')' ('.' anyname)* [targs]
typemember: tmbody (';' | ',')
tmbody: ('readonly' | '+' | '-' | 'get' | 'set')* (propkey ['?' | '-' '?'] [TPARAMS params] [typeann] | '[' ident (':' type | 'in' type ['as' type]) ']' ['?' | '-' '?'] typeann | ['new'] TPARAMS params [typeann])
targs: '<' type (',' type)* '>'
tparams: ['<' tparam (',' tparam)* [','] '>']
tparam: ['const'] ['in' | 'out'] ident ['extends' type] ['=' type]
interface: ['declare'] 'interface' ident TPARAMS ['extends' type (',' type)*] '{' typemember* [tmbody] '}'
typealias: ['declare'] 'type' ident TPARAMS '=' type
enum: ['declare'] ['const'] 'enum' ident '{' [enumitem (',' enumitem)* [',']] '}'
enumitem: propkey ['=' asg]
namespace: ['declare'] ('namespace' | 'module') (ident ('.' ident)* | STR) block
"""


def _expand(text: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        text = text.replace(k, v)
    return text


def _js_rules(typed: bool) -> str:
    if typed:
        table = {
            "TSEXPORTSIMPLE": "typealias | 'import' ident '=' expr | '=' expr", "TSIDENT": "'type' | 'declare' | 'namespace' | 'module' | 'readonly' | 'abstract' | 'keyof' | 'is' | 'infer' | 'asserts' | 'unique' | 'override' | 'public' | 'private' | 'protected' | 'satisfies'",
            "TSSIMPLE": "typealias", "TSSTMT": "interface [';'] | enum [';'] | namespace [';'] | 'declare' (vars | func) ';' | 'declare' class", "TSDECL": "interface | enum | namespace",
            "TPARAMS": "tparams", "TYPEANN": "typeann", "TSNOBODY": "';'", "TSMODS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
            "TSMOD": "('public' | 'private' | 'protected' | 'readonly' | 'override')*", "TSABSTRACT": "'abstract' | 'declare'", "TARGS": "targs", "TSIMPL": "'implements' type (',' type)*",
            "TSINDEX": "| '[' ident ':' type ']' typeann ';'", "ASTYPE": "(('as' | 'satisfies') (type | 'const'))*", "TSBANG": "| '!' | targs args", "DECOR": "decorator*",
        }
        return _expand(_JS + _TS_TYPES, table)
    table = {
        "TSEXPORTSIMPLE": "'default' 'async' asynctail", "TSIDENT": "ID", "TSSIMPLE": "'import' '(' asg ')'", "TSSTMT": "';'", "TSDECL": "func", "TPARAMS": "", "[TYPEANN]": "", "TYPEANN": "", "(block | TSNOBODY)": "block",
        "TSMODS": "", "TSMOD": "", "[TSABSTRACT]": "", "[TARGS]": "", "[TSIMPL]": "", "TSINDEX": "", "ASTYPE": "", "TSBANG": "", "DECOR": "decorator*", "['type']": "",
        "['?']": "", "['!']": "", "['?' | '!']": "",
    }
    return _expand(_JS, table)


_RS = """
prog: innerattr* item*
attr: '#' '[' tree* ']'
innerattr: '#' '!' '[' tree* ']'
tree: '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | anyname | STR | CHR | NUM | LIFE | PUNCT
vis: 'pub' ['(' ('crate' | 'self' | 'super' | 'in' path) ')']
item: attr* [vis] itembody | macroitem
itembody: fn | struct | enumd | uniond | impl | trait | modd | use | const | typealias | 'extern' (['crate'] ID ['as' ID] ';' | [STR] '{' innerattr* item* '}') | ['unsafe'] 'extern' [STR] '{' item* '}'
macroitem: attr* path '!' [ID] ('(' tree* ')' ';' | '[' tree* ']' ';' | '{' tree* '}')
fn: ('const' | 'async' | 'unsafe' | 'extern' [STR] | 'default')* 'fn' ID [generics] '(' [fnparam (',' fnparam)* [',']] ')' ['->' type] [where] (block | ';')
fnparam: attr* (['&' [LIFE]] ['mut'] 'self' [':' type] | pat ':' type | '...')
generics: '<' [gparam (',' gparam)* [',']] '>'
gparam: attr* (LIFE [':' [LIFE ('+' LIFE)*]] | ID [':' [bounds]] ['=' type] | 'const' ID ':' type ['=' (block | ['-'] literal)])
bounds: bound ('+' bound)* ['+']
bound: LIFE | ['?'] ['for' generics] typepath | '(' ['?'] ['for' generics] typepath ')'
where: 'where' [wpred (',' wpred)* [',']]
wpred: LIFE ':' bounds | ['for' generics] type ':' [bounds]
struct: 'struct' ID [generics] ([where] '{' [field (',' field)* [',']] '}' | '(' [tfield (',' tfield)* [',']] ')' [where] ';' | [where] ';')
uniond: 'union' ID [generics] [where] '{' [field (',' field)* [',']] '}'
field: attr* [vis] ID ':' type
tfield: attr* [vis] type
enumd: 'enum' ID [generics] [where] '{' [variant (',' variant)* [',']] '}'
variant: attr* ID ['{' [field (',' field)* [',']] '}' | '(' [tfield (',' tfield)* [',']] ')'] ['=' expr]
impl: ['unsafe'] 'impl' [generics] ['!'] type ['for' type] [where] '{' innerattr* implitem* '}'
trait: ['unsafe'] 'trait' ID [generics] [':' [bounds]] [where] '{' implitem* '}'
implitem: attr* [vis] (fn | 'const' ID ':' type ['=' expr] ';' | typealias) | macroitem
typealias: 'type' ID [generics] [':' bounds] [where] ['=' type] [where] ';'
modd: ['unsafe'] 'mod' ID (';' | '{' innerattr* item* '}')
use: 'use' usetree ';'
usetree: ['::'] pathid ('::' pathid)* ['::' ('*' | usegroup) | 'as' ID] | ['::'] ('*' | usegroup)
usegroup: '{' [usetree (',' usetree)* [',']] '}'
pathid: ID | 'crate' | 'self' | 'super' | 'Self' | 'union'
const: ('const' | 'static') ['mut'] ID ':' type '=' expr ';'
type: '&' [LIFE] ['mut'] type | '*' ('const' | 'mut') type | '[' type [';' expr] ']' | '(' [type (',' type)* [',']] ')' | '!' | 'ID_' | ('dyn' | 'impl') bounds | ['for' generics] ('unsafe' | 'extern' [STR])* 'fn' '(' [[ID ':'] type (',' [ID ':'] type)* [',']] ')' ['->' type] | typepath ['!' '(' tree* ')'] | qpath
qpath: '<' type ['as' typepath] '>' ('::' pathid [targs])+
typepath: ['::'] tseg ('::' tseg)*
tseg: pathid [['::'] targs | '(' [type (',' type)*] ')' ['->' type]]
targs: '<' [targ (',' targ)* [',']] '>'
targ: LIFE | type | literal | '-' literal | block | ID ['=' type] | ID ':' bounds
path: ['::'] pathid ('::' pathid)*
block: [LIFE ':'] ['unsafe' | 'async' ['move'] | 'const'] '{' innerattr* stmt* [expr] '}'
stmt: ';' | let | item | attr* exprblock | attr* expr ';'
let: attr* 'let' pat [':' type] ['=' expr ['else' block]] ';'
exprblock: block | [LIFE ':'] ('if' cond block elsepart | 'match' cond '{' innerattr* arm* [lastarm] '}' | 'while' cond block | 'loop' block | 'for' pat 'in' cond block)
elsepart: ['else' (block | 'if' cond block elsepart)]
cond: condpart ('&&' condpart)*
condpart: 'let' pat '=' binx | expr
arm: attr* ['|'] pat ['if' cond] '=>' (expr ',' | exprblock [','])
lastarm: attr* ['|'] pat ['if' cond] '=>' expr
pat: ['|'] pat1 ('|' pat1)*
pat1: ['ref'] ['mut'] ID ['@' pat1] | '&' ['mut'] pat1 | '&&' ['mut'] pat1 | patlit ['..' [patlit] | '..=' patlit | '...' patlit] | '..' [patlit] | '..=' patlit | '(' [pat (',' pat)* [',']] ')' | '[' [pat (',' pat)* [',']] ']' | ppath ['(' [pat (',' pat)* [',']] ')' | '{' [patfield (',' patfield)* [',']] '}'] | ppath '!' '(' tree* ')' | 'box' pat1
patlit: ['-'] literal | ppath
ppath: qpath | ['::'] pathid [['::'] targs] ('::' pathid ['::' targs])*
patfield: attr* ('..' | (ID | NUM) ':' pat | ['ref'] ['mut'] ID)
expr: ['return' | 'break' [LIFE]] range [asgop expr] | 'return' | 'break' [LIFE] | 'continue' [LIFE] | closure
asgop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
range: binx [('..' | '..=') [binx]] | ('..' | '..=') [binx]
binx: un (binop un)*
binop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>'
un: ('-' | '!' | '*' | '&' ['mut' | 'raw' ('const' | 'mut')] | '&&' ['mut'])* (post ('as' type)* | closure)
closure: ['async'] ['move'] ('||' | '|' [cparam (',' cparam)* [',']] '|') (['->' type] block | expr)
cparam: attr* pat1 [':' type]
post: prim trailer*
trailer: '?' | '.' (ID | NUM | 'await') ['::' targs] | args | '[' expr ']'
args: '(' [expr (',' expr)* [',']] ')'
prim: literal | exprpath ['!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}')] | structlit | '(' [expr (',' expr)* [',']] ')' | '[' [expr (',' expr)* [','] | expr ';' expr] ']' | exprblock
structlit: exprpath '{' [attr* slfield (',' slfield)* [',']] '}'
slfield: (ID | NUM) [':' expr] | '..' [expr]
exprpath: qpath | ['::'] pathid ['::' targs] ('::' pathid ['::' targs])*
literal: NUM | STR | CHR | 'true' | 'false'
"""
_GO = """
prog: 'package' ID ';' (import ';')* (top ';')*
import: 'import' (importspec | '(' [importspec (';' importspec)* [';']] ')')
importspec: ['.' | ID] STR
top: funcdecl | decl
decl: 'const' (constspec | '(' [constspec (';' constspec)* [';']] ')') | 'var' (varspec | '(' [varspec (';' varspec)* [';']] ')') | 'type' (typespec | '(' [typespec (';' typespec)* [';']] ')')
constspec: idlist [[type] '=' exprs]
varspec: idlist (type ['=' exprs] | '=' exprs)
typespec: ID [tparams] ['='] type
idlist: ID (',' ID)*
tparams: '[' tparam (',' tparam)* [','] ']'
tparam: idlist constraint
constraint: ['~'] type ('|' ['~'] type)*
funcdecl: 'func' [params] ID [tparams] sig [block]
sig: params [params | type]
params: '(' [param (',' param)* [',']] ')'
param: ID ['...'] type | ['...'] type
type: ID ['.' ID] ['[' type (',' type)* ']'] | '*' type | '[' [expr | '...'] ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' sig | 'struct' '{' [field (';' field)* [';']] '}' | 'interface' '{' [imember (';' imember)* [';']] '}' | '(' type ')'
field: (idlist type | ['*'] ID ['.' ID] ['[' type (',' type)* ']']) [STR]
imember: ID sig | constraint
block: '{' stmts '}'
stmts: (stmt ';' | ';')* [stmt]
stmt: decl | simple | 'return' [exprs] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | block | if | for | switch | select | ID ':' [stmt]
simple: exprs [asgop exprs | ':=' exprs | '++' | '--' | '<-' expr]
asgop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if: 'if' [[simple] ';'] expr block ['else' (if | block)]
for: 'for' [expr | [simple] ';' [expr] ';' [simple] | [exprs ('=' | ':=')] 'range' expr] block
switch: 'switch' [[simple] ';'] [simple] '{' case* '}'
case: ('case' (exprs | types) | 'default') ':' stmts
types: type (',' type)*
select: 'select' '{' comm* '}'
comm: ('case' simple | 'default') ':' stmts
exprs: expr (',' expr)*
expr: un (binop un)*
binop: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '<<' | '>>' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||'
un: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* post
post: prim trailer*
trailer: '.' (ID | '(' (type | 'type') ')') | '[' (expr [',' expr]* | [expr] ':' [expr] [':' expr]) ']' | '(' [arg (',' arg)* ['...'] [',']] ')' | lit
arg: expr | type
lit: '{' [elem (',' elem)* [',']] '}'
elem: (expr | lit) [':' (expr | lit)]
prim: ID | NUM | STR | CHR | '(' (expr | type) ')' | 'func' sig block | ctype
ctype: '[' [expr | '...'] ']' type | 'map' '[' type ']' type | 'struct' '{' [field (';' field)* [';']] '}' | 'interface' '{' [imember (';' imember)* [';']] '}' | 'chan' type
"""
_JAVA = """
prog: [annot* 'package' name ';'] (import | ';')* (typedecl | ';')*
name: id ('.' id)*
id: ID | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'non'
import: 'import' ['static'] name ['.' '*'] ';'
annot: '@' name ['(' [annval | id '=' annval (',' id '=' annval)*] ')']
annval: cond | annot | '{' [annval (',' annval)* [',']] '}'
mod: annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
typedecl: mod* (classd | interfaced | enumd | recordd | annotd)
classd: 'class' id [tparams] ['extends' type] ['implements' types] ['permits' types] body
interfaced: 'interface' id [tparams] ['extends' types] ['permits' types] body
annotd: '@' 'interface' id body
enumd: 'enum' id ['implements' types] '{' [econst (',' econst)*] [','] [';' member*] '}'
econst: annot* id [args] [body]
recordd: 'record' id [tparams] '(' [rparam (',' rparam)*] ')' ['implements' types] body
rparam: annot* type ['...'] id
types: type (',' type)*
body: '{' member* '}'
member: ';' | ['static'] block | mod* (classd | interfaced | enumd | recordd | annotd | method | ctor | fieldd)
method: [tparams] (type | 'void') id params dims [throws] (block | ['default' annval] ';')
ctor: [tparams] id [params] [throws] block
fieldd: type vdecl (',' vdecl)* ';'
vdecl: id dims ['=' vinit]
vinit: expr | '{' [vinit (',' vinit)* [',']] '}'
throws: 'throws' types
params: '(' [param (',' param)*] ')'
param: mod* type ['...'] (id dims | 'this')
dims: ('[' ']')*
tparams: '<' tparam (',' tparam)* '>'
tparam: annot* id ['extends' type ('&' type)*]
type: annot* (prim | id [targs] ('.' annot* id [targs])*) (annot* '[' ']')*
prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
targs: '<' [targ (',' targ)*] '>'
targ: type | annot* '?' [('extends' | 'super') type]
block: '{' stmt* '}'
stmt: ';' | block | local ';' | 'if' '(' expr ')' stmt ['else' stmt] | 'for' '(' ([forinit] ';' [expr] ';' [exprs] | mod* type id ':' expr) ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'try' [resources] block catch* ['finally' block] | 'switch' '(' expr ')' swbody | 'return' [expr] ';' | 'throw' expr ';' | 'break' [id] ';' | 'continue' [id] ';' | 'synchronized' '(' expr ')' block | 'assert' expr [':' expr] ';' | 'yield' expr ';' | id ':' stmt | exprstmt ';' | mod* (classd | interfaced | enumd | recordd)
exprstmt: un [asgop expr]
local: mod* type vdecl (',' vdecl)*
forinit: local | exprs
exprs: expr (',' expr)*
resources: '(' resource (';' resource)* [';'] ')'
resource: mod* type id '=' expr | post
catch: 'catch' '(' mod* type ('|' type)* id ')' block
swbody: '{' swcase* '}'
swcase: ('case' swlabel (',' swlabel)* ['when' expr] | 'default') (':' stmt* | '->' (expr ';' | block | 'throw' expr ';'))
swlabel: cond | type id | 'null' | 'default'
expr: lambda | cond [asgop expr]
asgop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
lambda: (id | '(' [lparam (',' lparam)*] ')') '->' (block | expr)
lparam: mod* [type] id
cond: bin ['?' expr ':' (lambda | cond)]
bin: un (binop un | 'instanceof' ['final'] type [id])*
binop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>'
un: ('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')')* (post ['++' | '--'] | lambda)
post: primary trailer*
trailer: '.' ([targs] id [args] | 'new' creator | 'this' | 'super' [args] | 'class') | '[' expr ']' | '::' [targs] (id | 'new')
primary: literal | id [args] | 'this' [args] | 'super' [args] | '(' expr ')' | 'new' creator | prim dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | id [targs] dims '::' ('new' | id) | 'switch' '(' expr ')' swbody
creator: annot* [targs] (id [targs] ('.' id [targs])* | prim) (args [body] | ('[' expr ']')+ dims | ('[' ']')+ '{' [vinit (',' vinit)* [',']] '}')
args: '(' [expr (',' expr)*] ')'
literal: NUM | STR | CHR | 'true' | 'false' | 'null'
"""
_PY = """
prog: (NL | stmt)*
stmt: simple (';' simple)* [';'] NL | compound
simple: 'pass' | 'break' | 'continue' | 'return' [star] | 'raise' [expr ['from' expr]] | 'global' ident (',' ident)* | 'nonlocal' ident (',' ident)* | 'del' star | 'assert' expr [',' expr] | imp | 'type' ident [tparams] '=' expr | exprstmt
exprstmt: star (asgtail | ('=' yieldstar)*) | annot | yield
annot: anntarget ':' expr ['=' yieldstar]
anntarget: (ident | '(' ident ')') trailer* | '[' [star] ']' trailer trailer*
asgtail: ('+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '//=' | '<<=' | '>>=' | '&=' | '|=' | '^=' | '@=') yieldstar
yieldstar: star | yield
yield: 'yield' ['from' expr | star]
imp: 'import' dotted ['as' ident] (',' dotted ['as' ident])* | 'from' ('.' | '...')* [dotted] 'import' ('*' | impname (',' impname)* | '(' impname (',' impname)* [','] ')')
impname: ident ['as' ident]
dotted: ident ('.' ident)*
compound: 'if' named ':' suite ('elif' named ':' suite)* ['else' ':' suite] | 'while' named ':' suite ['else' ':' suite] | ['async'] 'for' star 'in' star ':' suite ['else' ':' suite]
  | 'try' ':' suite (('except' ['*'] [star ['as' ident]] ':' suite)+ ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite) | ['async'] 'with' withitems ':' suite | decorated | 'match' star ':' NL INDENT mcase+ DEDENT
mcase: 'case' pats ['if' named] ':' suite
pats: pat (',' pat)* [',']
pat: '*' ident | palt ('|' palt)* ['as' ident]
palt: pvalue | dotted '(' [parg (',' parg)* [',']] ')' | '(' [pats] ')' | '[' [pats] ']' | '{' [pitem (',' pitem)* [',']] '}'
pvalue: ['-'] NUM [('+' | '-') NUM] | STR+ | 'None' | 'True' | 'False' | dotted
parg: [ident '='] pat
pitem: '**' ident | pvalue ':' pat
withitems: withitem (',' withitem)* | '(' withitem (',' withitem)* [','] ')'
withitem: expr ['as' post]
decorated: ('@' named NL)* (['async'] 'def' ident [tparams] '(' [dparams] ')' ['->' star] ':' suite | 'class' ident [tparams] [args] ':' suite)
tparams: '[' tparam (',' tparam)* [','] ']'
tparam: ['*' | '**'] ident [':' expr] ['=' expr]
dparams: dparam (',' dparam)* [',']
dparam: ident [':' expr] ['=' expr] | '*' [ident [':' ['*'] expr]] | '**' ident [':' expr] | '/'
suite: simple (';' simple)* [';'] NL | NL INDENT stmt+ DEDENT
star: staritem (',' staritem)* [',']
staritem: '*' bitor | named
named: expr [':=' expr]
expr: 'lambda' [lparams] ':' expr | or ['if' or 'else' expr]
lparams: lparam (',' lparam)* [',']
lparam: ident ['=' expr] | '*' [ident] | '**' ident | '/'
or: and ('or' and)*
and: not ('and' not)*
not: 'not'* comp
comp: bitor (('<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' ['not']) bitor)*
bitor: un (('+' | '-' | '*' | '/' | '%' | '//' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**') un)*
un: ('-' | '+' | '~' | 'await')* post
post: atom trailer*
trailer: '.' ident | args | '[' sub (',' sub)* [','] ']'
sub: [expr] ':' [expr] [':' [expr]] | staritem
args: '(' [arg (',' arg)* [',']] ')'
arg: named [comp_for] | ident '=' expr | '*' expr | '**' expr
comp_for: (['async'] 'for' star 'in' or)  compif* [comp_for]
compif: 'if' not (('and' | 'or') not)* | 'if' expr
atom: ident | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' [yield | star | named comp_for] ')' | '[' [star | named comp_for] ']' | '{' [dictitems | star | named comp_for | expr ':' expr comp_for] '}'
dictitems: dictitem (',' dictitem)* [',']
dictitem: expr ':' expr | '**' bitor
ident: ID | 'match' | 'case' | 'type'
"""
_JSON = """
prog: value
value: STR | NUM | '{' [STR ':' value (',' STR ':' value)*] '}' | '[' [value (',' value)*] ']'
"""
_TOML = """
prog: line (NL line)*
line: [key '=' value | '[' key ']' | '[[' key ']]']
key: part ('.' part)*
part: KEY | BOTH | STR
value: VAL | BOTH | STR | STR3 | '[' [value (',' value)* [',']] ']' | '{' [key '=' value (',' key '=' value)*] '}'
"""
_YAML = """
prog: [doc] (DOC [doc])*
doc: IN node OUT | flow | DOC
node: entry+ | item+ | VAL | flow
entry: KEY [VAL | flow | IN node OUT | item+]
item: '-' [VAL | flow | IN node OUT]
flow: '[' [felem (',' felem)* [',']] ']' | '{' [felem (',' felem)* [',']] '}'
felem: fval [':' [fval]]
fval: FSTR | flow
"""
_PUNCT = " | ".join(f"'{x}'" for x in "... ..= <<= .. :: -> => == != <= && || += -= *= /= %= &= |= ^= << - + * / % & | ^ ! < > = ? : ; , . # @ $ ~".split() if x != "~")


def language_rules(language: str) -> str:
    """The rules of js, ts, rs, go, java, py, json, toml or yaml."""
    return {
        "js": lambda: _js_rules(False), "ts": lambda: _js_rules(True), "rs": lambda: _RS.replace("PUNCT", _PUNCT).replace(" | 'ID_'", ""),
        "go": lambda: _GO.replace("(expr [',' expr]* |", "(arg (',' arg)* |"), "java": lambda: _JAVA.replace(" ['when' expr]", ""),
        "py": lambda: _PY, "json": lambda: _JSON, "toml": lambda: _TOML, "yaml": lambda: _YAML,
    }[language]()


@cache
def grammar(language: str) -> Grammar:
    """The grammar of a whole file."""
    return Grammar(language_rules(language), "prog", tuple(WORDS.get(language, "").split()))
