"""Grammars of the supported languages and dialects, over the tokens of graphloom.parse.lexers.

Operator precedence does not matter to whether a text is in the language, so expressions are operands between operators.
"""

from __future__ import annotations

from functools import lru_cache

from graphloom.llm.gll import Grammar, together
from graphloom.llm.rewrites import NotJsx, python2_tokens, without_jsx
from graphloom.parse.lexers import LexError, lex

PYTHON = r"""
file = (NL | stmt)* ;
stmt = simple | compound ;
simple = small (';' small)* ';'? NL ;
small = exprs | exprs AUG rhs | (tlist '=')+ rhs | target ':' expr ('=' rhs)? | '(' ID ')' ':' expr ('=' rhs)?
      | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | yieldx
      | ('global' | 'nonlocal') ID (',' ID)* | 'del' tlist | 'assert' expr (',' expr)?
      | 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)*
      | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | asname (',' asname)* | '(' asname (',' asname)* ','? ')')
      | SOFTTYPE ID tparams? '=' expr ;
asname = ID ('as' ID)? ;
dotted = ID ('.' ID)* ;
rhs = exprs | yieldx ;
yieldx = 'yield' exprs? | 'yield' 'from' expr ;
exprs = starx (',' starx)* ','? ;
starx = '*' disj | named ;
named = ID ':=' expr | expr ;
expr = 'lambda' lparams? ':' expr | disj ('if' disj 'else' expr)? ;
disj = PRE* primary (bin PRE* primary)* ;
bin = BIN | '*' | '-' | '**' | '@' | 'in' | 'is' | 'not' 'in' | 'is' 'not' ;
primary = 'await'? atom trailer* ;
atom = ID | NUM | CONST | '...' | (STR | fstring)+ | '(' ')' | '(' yieldx ')' | '(' starx comp ')' | '(' exprs ')'
     | '[' ']' | '[' starx comp ']' | '[' exprs ']' | '{' '}' | '{' starx comp '}' | '{' exprs '}' | '{' pair (comp | (',' pair)* ','?) '}' ;
pair = expr ':' expr | '**' disj ;
fstring = SH rhs (SM rhs)* ST ;
comp = ('async'? 'for' tlist 'in' disj ('if' cond)*)+ ;
cond = ID ':=' disj | disj | 'lambda' lparams? ':' cond ;
trailer = '.' ID | '(' args? ')' | '[' sub (',' sub)* ','? ']' ;
sub = named | '*' disj | expr? ':' expr? (':' expr?)? ;
args = named comp | (pos | kwd | '**' expr) ','? | pos (',' pos)* (',' kwd)* (',' kk)* ','? | kwd (',' (kwd | '*' expr))* (',' kk)* ','? | '**' expr (',' kk)* ','? ;
pos = named | '*' expr ;
kwd = ID '=' expr | '*' expr ;
kk = ID '=' expr | '**' expr ;
tlist = starget (',' starget)* ','? ;
starget = '*'? target ;
target = ID | '(' tlist? ')' | '[' tlist? ']' | 'await'? atom trailer* ('.' ID | '[' sub (',' sub)* ','? ']') ;
compound = 'if' named ':' block ('elif' named ':' block)* elsex? | 'while' named ':' block elsex?
     | 'async'? 'for' tlist 'in' exprs ':' block elsex? | 'async'? 'with' withs ':' block
     | 'try' ':' block ((except+ elsex? finally?) | finally)
     | ('@' named NL)* (classdef | funcdef)
     | SOFTMATCH exprs ':' NL IN (SOFTCASE patterns ('if' named)? ':' block)+ DE ;
elsex = 'else' ':' block ;
finally = 'finally' ':' block ;
except = 'except' '*'? (expr ('as' ID)?)? ':' block ;
withs = with (',' with)* | '(' with (',' with)* ','? ')' ;
with = expr ('as' starget)? ;
block = simple | NL IN stmt+ DE ;
classdef = 'class' ID tparams? ('(' args? ')')? ':' block ;
funcdef = 'async'? 'def' ID tparams? '(' params? ')' ('->' exprs)? ':' block ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? ID (':' expr)? ('=' expr)? ;
params = head (',' star)? ','? | star ','? ;
head = p (',' (p | '/'))* (',' (d | '/'))* | d (',' (d | '/'))* ;
star = '*' (ID (':' ('*'? expr))?)? (',' (p | d))* (',' '**' p)? | '**' p ;
p = ID (':' expr)? ;
d = p '=' expr ;
lparams = lhead (',' lstar)? ','? | lstar ','? ;
lhead = ID (',' (ID | '/'))* (',' (ld | '/'))* | ld (',' (ld | '/'))* ;
lstar = '*' ID? (',' (ID | ld))* (',' '**' ID)? | '**' ID ;
ld = ID '=' expr ;
patterns = pattern (',' pattern?)* | '*' ID (',' pattern)* ;
pattern = closed ('|' closed)* ('as' ID)? ;
closed = '-'? NUM (('-' | BIN) NUM)? | CONST | (STR | fstring)+ | dotted ('(' (pattern | ID '=' pattern) (',' (pattern | ID '=' pattern))* ','? ')' | '(' ')')?
     | '(' patitems? ')' | '[' patitems? ']' | '{' (patpair (',' patpair)* ','?)? '}' ;
patitems = ('*' ID | pattern) (',' ('*' ID | pattern))* ','? ;
patpair = closed ':' pattern | '**' ID ;
"""
# What Python 2 says otherwise: statements print and exec, exceptions and values after a comma.
PYTHON2 = {
    "| 'pass' |": "| PRINT (exprs | '>>' expr (',' exprs)?)? | EXEC disj ('in' expr (',' expr)?)? | 'pass' |",
    "'raise' (expr ('from' expr)?)?": "'raise' (expr (',' expr (',' expr)?)?)?",
    "(expr ('as' ID)?)? ':' block ;\nwiths": "(expr (('as' | ',') target)?)? ':' block ;\nwiths",
    "| SOFTMATCH exprs ':' NL IN (SOFTCASE patterns ('if' named)? ':' block)+ DE ;": ";",
    "p = ID (':' expr)? ;": "p = ID | '(' ID (',' ID)* ','? ')' ;",
}
_ECMA_EXPR = r"""
expr = aexpr (',' aexpr)* ;
aexpr = unit (bin unit | SUFFIXTYPE)* ('?' aexpr ':' aexpr)? ;
unit = PRES* post | arrow | 'yield' '*'? aexpr? | ASSERTION ;
sunit = PRE+ post | NPRE* npost | arrow | 'yield' '*'? aexpr? ;
sexpr = sunit (bin unit | SUFFIXTYPE)* ('?' aexpr ':' aexpr)? (',' aexpr)* ;
bin = BIN | '-' | '+' | '/' | '*' | '<' | '=' | 'in' | 'of' | 'instanceof' | '>' ('>' '>'?)? '='? ;
post = (nprim | obj | func | class) suf* ;
npost = nprim suf* ;
PRESRULE
nprim = ID | THIS | NUM | STR | tpl | '(' expr ')' | '[' elems? ']' | 'new' '.' ID | 'import' ('.' ID | '(' aexpr (',' aexpr)? ','? ')') ;
elems = ','+ (el (','+ el)* ','*)? | el (','+ el)* ','* ;
el = '...'? aexpr ;
tpl = SH expr (SM expr)* ST ;
suf = '.' IDK | '?.' (IDK | '[' expr ']' | '(' args? ')') | '[' expr ']' | '(' args? ')' | tpl | STR | INCR TSSUF ;
args = el (',' el)* ','? ;
obj = '{' (prop (',' prop)* ','?)? '}' ;
prop = '...' aexpr | key ':' aexpr | ID ('=' aexpr)? | method ;
key = IDK | STR | NUM | '[' aexpr ']' ;
func = 'async'? 'function' '*'? ID? TPARAMS '(' params? ')' RET block ;
deco = '@' ID ('.' ID)* ('(' args? ')')* | '@' '(' expr ')' | DECO ('.' IDK)* ('(' args? ')')* ;
block = '{' stmt* '}' ;
pattern = ID | '[' (','* pel? (','+ pel)* ','*) ']' | '{' (pprop (',' pprop)* ','?)? '}' ;
pel = '...' pattern | pattern ('=' aexpr)? ;
pprop = '...' pattern | ID ('=' aexpr)? | key ':' pattern ('=' aexpr)? ;
END = ';' | NL ;
vars = ('var' | LET | 'const') var (',' var)* ;
casex = ('case' expr | 'default') ':' stmt* ;
for = 'for' 'await'? '(' (forhead (';' expr? ';' expr? | ('of' aexpr | 'in' expr)) | ';' expr? ';' expr?) ')' stmt ;
forhead = ('var' | LET | 'const') var (',' var)* | sexpr | pattern ;
control = block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' end?
     | 'try' block ('catch' ('(' pattern RET ')')? block ('finally' block)? | 'finally' block)
     | 'switch' '(' expr ')' '{' casex* '}' | ID ':' stmt WITH
     | 'return' expr? end | 'throw' expr end | ('break' | 'continue') ID? end | 'debugger' end ;
end = ';' | NL ;
frm = ('from' | FROM) STR (('with' | ASSERT) obj)? ;
names = '{' (nm (',' nm)* ','?)? '}' ;
nm = TYPEONLY (IDK | STR) (AS (IDK | STR))? ;
"""
_JS = r"""
file = item* ;
item = stmt MODULEITEM ;
stmt = control | vars end | sexpr end | func | deco* class ;
var = pattern ('=' aexpr)? ;
arrow = 'async'? (ID | '(' params? ')') '=>' (aexpr | block) ;
params = param (',' param)* (',' '...' pattern)? ','? | '...' pattern ;
param = pattern ('=' aexpr)? ;
method = ('async' | GETSET | '*')* key '(' params? ')' block ;
class = 'class' ID? ('extends' post)? '{' member* '}' ;
member = ';' | deco* STATIC? (method | GETSET? key ('=' aexpr)? end) | STATIC block ;
"""
_TS_EXTRA = r"""
file = item* ;
item = stmt MODULEITEM | 'export' '=' expr end | 'import' TYPEONLY ID '=' (ID ('.' ID)* ('(' STR ')')?) end | 'export' 'import' ID '=' ID ('.' ID)* end | 'export' AS NAMESPACE ID end ;
stmt = control | vars end | sexpr end | func | 'async'? 'function' '*'? ID tparams? '(' params? ')' ret? end | deco* ABSTRACT? class | decl | DECLARE (decl | vars end | ABSTRACT? class | func | 'function' ID tparams? '(' params? ')' ret? end | GLOBAL block) ;
decl = INTERFACE ID tparams? ('extends' tref (',' tref)*)? members | TYPE ID tparams? '=' type end | 'const'? 'enum' ID '{' (enumm (',' enumm)* ','?)? '}'
     | (NAMESPACE | MODULE) (ID ('.' ID)* | STR) '{' item* '}' ;
enumm = (IDK | STR | '[' aexpr ']') ('=' aexpr)? ;
var = pattern '!'? (':' type)? ('=' aexpr)? ;
arrow = 'async'? (ID '=>' | tparams? '(' params? ')' ret? '=>') (aexpr | block) ;
params = param (',' param)* (',' deco* '...' pattern (':' type)?)? ','? | deco* '...' pattern (':' type)? ;
param = deco* MOD* (pattern | THIS) '?'? (':' type)? ('=' aexpr)? ;
method = (MOD | 'async' | GETSET | '*')* key '?'? tparams? '(' params? ')' ret? (block | end) ;
class = 'class' ID? tparams? ('extends' post targs?)? (IMPLEMENTS tref (',' tref)*)? '{' member* '}' ;
member = ';' | deco* MOD* (method | GETSET? key ('?' | '!')? (':' type)? ('=' aexpr)? end | '[' ID ':' type ']' ':' type end) | MOD block ;
ret = ':' (ASSERTS (ID | THIS) (IS type)? | type | (ID | THIS) IS type) ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' | 'in' | MOD)* ID ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* ','? '>' ;
tref = ID ('.' ID)* targs? | nprim suf* targs? ;
type = ABSTRACT? 'new'? tparams? '(' params? ')' '=>' (type | ASSERTS? (ID | THIS) (IS type)?) | utype ('extends' utype '?' type ':' type)? ;
utype = TOR? tpost (TOR tpost)* ;
tpost = TOPER* tprim ('[' type? ']')* ;
tprim = (ID | 'void' | THIS | 'null') ('.' IDK)* targs? | STR | '-'? NUM | SH type (SM type)* ST | members | '[' (telem (',' telem)* ','?)? ']' | '(' type ')'
     | 'typeof' (ID | 'import' '(' STR ')' | THIS) ('.' IDK)* targs? | 'import' '(' STR ')' ('.' IDK)* targs? ;
telem = '...'? (IDK '?'? ':')? type '?'? ;
members = '{' tmember* '}' ;
tmember = ('-' | '+')? MOD* (GETSET? key '?'? (':' type)? | 'new'? tparams? '(' params? ')' ret? | GETSET? key '?'? tparams? '(' params? ')' ret? | '[' ID ':' type ']' ':' type | '[' ID 'in' type (AS type)? ']' (('-' | '+')? '?')? (':' type)?) (';' | ',' | NL)+ ;
"""
_MODULE = r"""| 'import' (STR (('with' | ASSERT) obj)? | TYPEONLY (ID (',' ('*' AS ID | names))? | '*' AS ID | names) frm) end
  | 'export' ('default' (func | deco* ABSTRACTCLASS | sexpr end) | TYPEONLY names frm? end | TYPEONLY '*' (AS (IDK | STR))? frm end | vars end | func | deco* ABSTRACTCLASS EXPORTED)"""

JAVA = r"""
file = (annotation* 'package' name ';')? item* ;
item = 'import' 'static'? name ('.' '*')? ';' | MODULEKW 'module'? | typedecl | ';' | method0 ;
method0 = mods? tparams? (type | 'void') ID '(' params? ')' dims? throws? block | mods? type vardecl (',' vardecl)* ';' ;
name = ID ('.' ID)* ;
mods = (MOD | SEALED | annotation | 'default' | 'static' | 'final' | 'abstract' | 'synchronized')+ ;
annotation = '@' name ('(' (annval | ID '=' annval (',' ID '=' annval)*)? ')')? ;
annval = texpr | annotation | '{' (annval (',' annval)* ','?)? '}' ;
typedecl = mods? ( 'class' ID tparams? ('extends' type)? ('implements' types)? (PERMITS types)? body
  | 'interface' ID tparams? ('extends' types)? (PERMITS types)? body
  | '@' 'interface' ID body
  | 'enum' ID ('implements' types)? '{' (econst (',' econst)*)? ','? (';' member*)? '}'
  | RECORD ID tparams? '(' params? ')' ('implements' types)? body ) ;
econst = annotation* ID ('(' args? ')')? body? ;
types = type (',' type)* ;
body = '{' member* '}' ;
member = ';' | 'static'? block | typedecl | mods? tparams? (type | 'void') ID '(' params? ')' dims? throws? ('default' annval)? (block | ';')
  | mods? tparams? ID '(' params? ')' throws? block | mods? ID block | mods? type vardecl (',' vardecl)* ';' ;
throws = 'throws' types ;
vardecl = ID dims? ('=' init)? ;
init = expr | '{' (init (',' init)*)? ','? '}' ;
dims = (annotation* '[' ']')+ ;
params = param (',' param)* ;
param = mods? type ('...' | annotation+ '...')? (ID dims? | (ID '.')? 'this') ;
tparams = '<' tparam (',' tparam)* '>' ;
tparam = annotation* ID ('extends' type ('&' type)*)? ;
type = annotation* (PRIM | ID targs? ('.' annotation* ID targs?)*) dims? ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = type | annotation* '?' (('extends' | 'super') type)? ;
block = '{' bstmt* '}' ;
bstmt = mods? type vardecl (',' vardecl)* ';' | typedecl | stmt ;
stmt = block | ';' | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (mods? type vardecl (',' vardecl)* | sexpr (',' sexpr)*)? ';' expr? ';' (sexpr (',' sexpr)*)? ')' stmt
  | 'for' '(' mods? type ID dims? ':' expr ')' stmt
  | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ID? ';' | YIELD expr ';' | 'assert' expr (':' expr)? ';'
  | 'synchronized' '(' expr ')' block | ID ':' stmt | switch
  | 'try' ('(' res (';' res)* ';'? ')')? block ('catch' '(' mods? type ('|' type)* ID ')' block)* ('finally' block)? ;
res = mods? type ID '=' expr | post ;
switch = 'switch' '(' expr ')' '{' (label bstmt* | arrowlabel (expr ';' | block | 'throw' expr ';'))* '}' ;
label = ('case' caseitem (',' caseitem)* | 'default') (WHEN texpr)? ':' ;
arrowlabel = ('case' caseitem (',' caseitem)* | 'default') (WHEN texpr)? '->' ;
caseitem = texpr | 'default' | pat ;
pat = mods? type ID | type '(' (pat (',' pat)*)? ')' ID? ;
sexpr = INCR post | post INCR* | post ('=' | ASSIGN | '>' '>' '>'? '=') expr | lastcall ;
lastcall = post ;
expr = texpr (('=' | ASSIGN | '>' '>' '>'? '=') texpr)* ;
texpr = unit (bin unit | 'instanceof' 'final'? (type ID? | pat))* ('?' expr ':' texpr)? ;
bin = BIN | '<' | '&' | '|' | '>' ('>' '>'? | '=')? ;
unit = (PRE | INCR | '(' type ('&' type)* ')')* (post INCR* | lambda) | switch ;
lambda = (ID | '(' (ID (',' ID)* | params)? ')') '->' (expr | block) ;
post = prim suf* ;
prim = ID | LIT | 'this' | 'super' | '(' expr ')' | new | (PRIM dims? | ID dims | 'void') '.' 'class' | ID ('.' ID)* dims '.' 'class' | (PRIM dims | ID targs ('.' ID targs?)* dims? | ID ('.' ID)* dims) '::' (ID | 'new') ;
new = 'new' annotation* (PRIM | ID targs? ('.' ID targs?)*) ('(' args? ')' body? | ('[' expr ']')+ dims? | dims '{' (init (',' init)*)? ','? '}') ;
suf = '.' (targs? ID | 'this' | 'class' | targs? 'super' | new) | '[' expr ']' | '(' args? ')' | '::' targs? (ID | 'new') ;
args = expr (',' expr)* ;
"""
KOTLIN = r"""
file = (FILEANN ':'? ('[' annbody+ ']' | annbody) end?)* (PACKAGE name end)? (IMPORT name ('.' '*' | AS ID)? end | ';')* (decl | ';' | NL)* ;
end = (';' | NL)+ ;
name = ID ('.' ID)* ;
annbody = ID ('.' ID)* targs? vargs? ;
annotation = '@' (ID ':')? ('[' annbody+ ']' | annbody) ;
mods = (MOD | annotation)+ ;
decl = mods? ( ('class' | 'fun'? 'interface') ID tparams? (ctor)? (':' supers)? where? body?
  | 'object' ID (':' supers)? body? | COMPANION 'object' ID? (':' supers)? body?
  | 'fun' tparams? fname fparams (':' type)? where? fbody?
  | ('val' | 'var') tparams? (rtype '.')? (ID (':' type)? | destruct) where? (('=' | BY) expr)? (';'? NL? accessor)*
  | TYPEALIAS ID tparams? '=' type ) ;
ctor = (mods? CONSTRUCTOR | mods CONSTRUCTOR)? '(' (cparam (',' cparam)* ','?)? ')' ;
cparam = mods? ('val' | 'var')? ID ':' type ('=' expr)? ;
supers = super (',' super)* ;
super = annotation* (type vargs? (BY expr)?) ;
where = WHERE annotation* ID ':' type (',' annotation* ID ':' type)* ;
body = '{' (member | ';' | NL)* '}' ;
member = decl | enume | INIT block | mods? CONSTRUCTOR fparams (':' ('this' | 'super') vargs)? block? ;
enume = mods? ID vargs? body? (',' mods? ID vargs? body?)* ','? ;
fname = (rtype '.')? ID ;
rtype = mods? (ID targs? ('.' ID targs?)* '?'* | '(' type ')' '?'*) ;
fparams = '(' (fparam (',' fparam)* ','?)? ')' ;
fparam = mods? ID (':' type)? ('=' expr)? ;
fbody = block | '=' expr ;
accessor = mods? (GET ('(' ')' (':' type)? fbody)? | SET ('(' mods? ID (':' type)? ','? ')' (':' type)? fbody)?) ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = mods? ('in' | OUT)* ID (':' type)? ;
type = (mods | SUSPEND)? (DYNAMIC | tatom) ('&' tatom)* ;
tatom = ID targs? ('.' ID targs?)* Q* | '(' type ')' Q* ('.' '(' tlist? ')' '->' type)? | (rtype '.')? '(' tlist? ')' '->' type ;
Q2 = Q ;
tlist = (ID ':')? type (',' (ID ':')? type)* ','? ;
targs = '<' targ (',' targ)* ','? '>' ;
targ = '*' | ('in' | OUT)? type ;
block = '{' stmts? '}' ;
stmts = end | end? bstmt (end bstmt)* end? ;
bstmt = decl | stmt ;
stmt = annotation* (LABEL)? (loop | expr (('=' | ASSIGN) expr)?) ;
loop = 'for' '(' annotation* (ID (':' type)? | destruct) 'in' expr ')' (cbody | ';') | 'while' '(' expr ')' (cbody | ';') | 'do' cbody? 'while' '(' expr ')' ;
cbody = block | stmt ;
destruct = '(' ID (':' type)? (',' ID (':' type)?)* ','? ')' ;
expr = unit (bin unit | AS '?'? type | ('is' | '!' 'is') type)* ;
bin = BIN | '-' | '+' | '*' | '<' | '>' '='? | 'in' | '!' 'in' | ID ;
unit = (PRE | '-' | '+' | '!' | annotation | LABEL)* post ;
post = prim suf* ;
prim = ID | LIT | string | 'this' ATLABEL? | 'super' targs? ATLABEL? | '(' expr ')' | lambda | if | when | try | 'object' (':' supers)? body | 'fun' (rtype '.')? fparams (':' type)? fbody
  | ('return' ATLABEL? expr?) | 'throw' expr | ('break' | 'continue') ATLABEL? | '::' (ID | 'class') | '[' (expr (',' expr)* ','?)? ']' | CLASSREF ;
string = SH NL* expr NL* (SM expr)* ST ;
if = 'if' '(' expr ')' (cbody (';'? NL? 'else' (cbody | ';')?)? | ';'? 'else' cbody) ;
when = 'when' ('(' annotation* ('val' ID (':' type)? '=')? expr ')')? '{' (wentry | NL | ';')* '}' ;
wentry = (wcond (',' wcond)* ','? ('if' expr)? | 'else') '->' cbody end? ;
wcond = expr | ('in' | '!' 'in') expr | ('is' | '!' 'is') type ;
try = 'try' block (NL? 'catch' '(' annotation* ID ':' type ','? ')' block)* (NL? 'finally' block)? ;
lambda = '{' (lparam (',' lparam)* ','? '->')? stmts? '}' | '{' '->' stmts? '}' ;
lparam = ID (':' type)? | destruct (':' type)? ;
suf = ('.' | '?.') (ID | 'class' | '(' expr ')') | Q* '::' (ID | 'class') | '[' expr (',' expr)* ','? ']' | targs? vargs | targs? vargs? LABEL? lambda | '++' | '--' | '!!' ;
vargs = '(' (varg (',' varg)* ','?)? ')' ;
varg = (ID '=')? '*'? expr ;
"""
RUST = r"""
file = inner* item* ;
inner = '#' '!' '[' tt* ']' ;
attr = '#' '[' tt* ']' ;
tt = '(' tt* ')' | '[' tt* ']' | '{' tt* '}' | ANY ;
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? | 'crate' ;
item = attr* (vis? bare | macroitem) ;
macroitem = path '!' ID? ('(' tt* ')' ';' | '[' tt* ']' ';' | '{' tt* '}') ;
bare = 'use' usetree ';' | 'mod' ID (';' | '{' inner* item* '}') | 'extern' 'crate' (ID | 'self') ('as' ID)? ';'
  | fn | 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';'
  | 'struct' ID generics? (where? fields | '(' (tfield (',' tfield)* ','?)? ')' where? ';' | where? ';')
  | 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' | UNION ID generics? where? fields
  | 'const' (ID | '_') (':' type)? ('=' expr)? ';' | 'static' 'mut'? ID ':' type ('=' expr)? ';'
  | 'unsafe'? AUTO? 'trait' ID generics? (':' bounds?)? where? '{' inner* assoc* '}' | 'trait' ID generics? '=' bounds ';'
  | 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' inner* assoc* '}' | 'unsafe'? 'extern' STR? '{' inner* assoc* '}' ;
assoc = attr* (vis? DEFAULT? bare | macroitem) ;
usetree = (path? '::')? ('*' | '{' (usetree (',' usetree)* ','?)? '}') | '::'? path ('as' (ID | '_'))? ;
fn = ('const' | 'async' | 'unsafe' | SAFE | 'extern' STR?)* 'fn' ID generics? '(' fparams? ')' ('->' type)? where? (block | ';') ;
fparams = fparam (',' fparam)* ','? ;
fparam = attr* ('&'? LIFE? 'mut'? 'self' (':' type)? | pat ':' (type | '...') | '...' | type) ;
fields = '{' (field (',' field)* ','?)? '}' ;
field = attr* vis? ID ':' type ('=' expr)? ;
tfield = attr* vis? type ;
variant = attr* vis? ID (fields | '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)? ;
generics = '<' (gparam (',' gparam)* ','?)? '>' ;
gparam = attr* (LIFE (':' (LIFE ('+' LIFE)* '+'?)?)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' (block | '-'? LIT | ID))?) ;
where = 'where' (wpred (',' wpred)* ','?)? ;
wpred = LIFE ':' (LIFE ('+' LIFE)*)? | forlt? type ':' bounds? ;
forlt = 'for' generics ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFE | '?' ? TILDE? 'const'? 'async'? forlt? tpath | '(' '?'? forlt? tpath ')' | 'use' generics ;
path = ('::')? seg ('::' seg)* ;
seg = ID | 'super' | 'self' | 'crate' | 'Self' | '$' 'crate' ;
tpath = ('::')? tseg ('::' tseg)* | '<' type ('as' tpath)? '>' ('::' tseg)+ ;
tseg = seg ('::'? targs | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
targs = '<' (targ (',' targ)* ','?)? '>' ;
targ = LIFE | type | ID targs? ('=' type | ':' bounds) | '-'? LIT | block ;
type = tpath | '(' (type (',' type)* ','?)? ')' | '!' | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '_'
  | ('impl' | 'dyn') bounds | forlt? ('unsafe' | 'extern' STR?)* 'fn' '(' (bareparam (',' bareparam)* ','?)? ')' ('->' type)? | forlt tpath | path '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') ;
bareparam = attr* ((ID | '_') ':')? (type | '...') ;
pat = '|'? pat1 ('|' pat1)* ;
pat1 = '_' | '..' | ('ref')? 'mut'? ID ('@' pat1)? | '-'? LIT (RANGE ('-'? LIT | pathx)?)? | RANGE ('-'? LIT | pathx) | ('&' | '&&') 'mut'? pat1 | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']'
  | pathx ('(' (pat (',' pat)* ','?)? ')' | '{' (patf (',' patf)* ','?)? '}' | RANGE ('-'? LIT | pathx)?)? | path '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') | 'box' pat1 | 'const' block ;
patf = attr* ('..' | (ID | NUM) ':' pat | 'box'? 'ref'? 'mut'? ID) ;
block = '{' inner* stmt* bexpr? '}' ;
bexpr = attr* expr ;
stmt = ';' | item | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocklike ;
blocklike = LABEL? ('unsafe' | 'async' 'move'? | 'const' | 'try')? block | if | match | LABEL? 'while' cond block | LABEL? 'loop' block | LABEL? 'for' pat 'in' expr block ;
LABEL2 = LIFE ':' ;
if = 'if' cond block ('else' (if | block))? ;
cond = expr ;
match = 'match' expr '{' inner* (arm | lastarm)* '}' ;
arm = attr* pat ('if' expr)? '=>' (expr ',' | blocklike ','?) ;
lastarm = attr* pat ('if' expr)? '=>' expr ;
expr = unit (bin unit | 'as' type | RANGE | RANGE unit)* | RANGE (unit (bin unit)*)? ;
bin = BIN | '-' | '+' | '*' | '&' | '&&' | '|' | '||' | '<' | '=' | '>' ('>' '='? | '=')? ;
unit = (PREX | 'mut')* post | ('return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr?) | closure | 'let' pat '=' expr ;
PREX2 = '-' ;
closure = forlt? 'static'? 'async'? 'move'? ('||' | '|' (attr* pat1 (':' type)? (',' attr* pat1 (':' type)?)* ','?)? '|') ('->' type block | expr) ;
post = prim suf* ;
suf = '.' (ID | NUM | 'await' | seg ('::' targs)?) | '(' args? ')' | '[' expr ']' | '?' ;
args = attr* expr (',' attr* expr)* ','? ;
prim = LIT | pathx ('{' (finit (',' finit)*)? (',' '..' expr?)? ','? '}' | '{' '..' expr? '}')? | path '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?)?)? ']'
  | blocklike | '_' ;
finit = attr* (ID (':' expr)? | NUM ':' expr) ;
pathx = ('::')? xseg ('::' xseg)* | '<' type ('as' tpath)? '>' ('::' xseg)+ ;
xseg = seg | targs ;
"""


def _sub(text: str, **to: str) -> str:
    for k, v in to.items():
        text = text.replace(k, v)
    return text


def _ecma(module: bool, ts: bool) -> Grammar:
    if ts:
        exported = "| deco* decl | ABSTRACT? class | DECLARE (decl | vars end | ABSTRACT? class | 'function' ID tparams? '(' params? ')' ret? end) | 'async'? 'function' '*'? ID? tparams? '(' params? ')' ret? end"
        text = _TS_EXTRA + _ECMA_EXPR
        text = _sub(text, SUFFIXTYPE="AS type | 'satisfies' type | AS 'const'", ASSERTION="'<' type '>' unit", TSSUF="| '!' | targs '(' args? ')' | targs tpl | targs STR", TPARAMS="tparams?", RET="ret?")
        text = _sub(text, MODULEITEM=_MODULE if module else "", TYPEONLY="TYPE?", ABSTRACTCLASS="ABSTRACT? class", EXPORTED=exported)
        text = text.replace("'default' (func |", "'default' (func | 'async'? 'function' '*'? ID? tparams? '(' params? ')' ret? end | INTERFACE ID tparams? ('extends' tref (',' tref)*)? members |")
    else:
        text = _JS + _ECMA_EXPR
        text = _sub(text, SUFFIXTYPE="NEVER", ASSERTION="NEVER", TSSUF="", TPARAMS="", RET="")
        text = _sub(text, MODULEITEM=_MODULE if module else "", TYPEONLY="", ABSTRACTCLASS="class", EXPORTED="")
    text = _sub(text, PRESRULE="", WITH="" if module else "| 'with' '(' expr ')' stmt", LABEL="NEVER")
    text = text.replace("PRES*", "(PRE | NPRE | INCR)*").replace("NPRE*", "(NPRE | INCR)*").replace("PRE+", "(PRE | NPRE | INCR)+")
    text = text.replace("END = ';' | NL ;", "")
    return Grammar(text)


_JS_KW = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new null return super switch this throw try typeof var void while with true false enum".split())
_JS_PRE = frozenset("! ~ typeof void delete".split())
_JS_SOFT = {
    "let": "LET", "static": "STATIC", "get": "GETSET", "set": "GETSET", "accessor": "GETSET", "from": "FROM", "as": "AS", "type": "TYPE", "interface": "INTERFACE", "namespace": "NAMESPACE", "module": "MODULE", "declare": "DECLARE", "abstract": "ABSTRACT",
    "implements": "IMPLEMENTS", "asserts": "ASSERTS", "is": "IS", "global": "GLOBAL", "of": "of", "async": "async", "satisfies": "satisfies", "assert": "ASSERT", "yield": "yield",
}
_JS_STRICT = frozenset("let static implements interface package private protected public yield".split())
_TS_MOD = frozenset("public private protected static readonly abstract override declare in out accessor".split())
_ASSIGN = frozenset("+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())


def _ecma_terms(ts: bool, module: bool):
    def terms(kind: str, t: str) -> tuple[str, ...]:
        if kind == "id":
            if t[0] == "@":
                return ("DECO",)
            if t[0] == "#":
                return ("IDK", "ID")
            if t in _JS_KW:
                out = ["IDK", t]
                if t in ("this", "super", "null", "true", "false"):
                    out.append("THIS")
                if t in _JS_PRE:
                    out.append("PRE")
                if t == "new":
                    out.append("NPRE")
                if ts and t == "in":
                    out.append("MOD")
                return tuple(out)
            out = ["IDK", "ID"]
            if t == "await":
                out = ["IDK", "PRE", "await"] + ([] if module else ["ID"])
            if module and t in _JS_STRICT and not ts:
                out.remove("ID")
            s = _JS_SOFT.get(t)
            if s:
                out.append(s)
            if ts and t in _TS_MOD:
                out.append("MOD")
            if ts and t in ("keyof", "unique", "readonly", "infer", "asserts"):
                out.append("TOPER")
            return tuple(out)
        if kind in ("num", "str"):
            return (kind.upper(),)
        if kind in ("sh", "sm", "st", "nl"):
            return (kind.upper(),)
        if t in ("!", "~"):
            return ("PRE", t)
        if t in ("+", "-"):
            return (t, "PRE")
        if t in ("++", "--"):
            return ("INCR",)
        if t in ("|", "&"):
            return ("BIN", "TOR")
        if t in _ASSIGN or t in ("==", "!=", "===", "!==", "**", "??", "||", "&&", "<=", "<<", "%", "^"):
            return ("BIN",)
        return (t,)

    return terms


_PY_KW = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


def _py_terms(kind: str, t: str) -> tuple[str, ...]:
    if kind == "id":
        if t in ("True", "False", "None", "__debug__"):
            return ("CONST",)
        if t in ("and", "or"):
            return ("BIN",)
        if t == "not":
            return ("PRE", "not")
        if t in _PY_KW:
            return (t,)
        if t in ("match", "case", "type"):
            return ("ID", "SOFT" + t.upper())
        return ("ID",)
    if kind in ("num", "str", "sh", "sm", "st", "nl", "in", "de"):
        return (kind.upper(),)
    if t == "-":
        return ("-", "PRE")
    if t in ("+", "~"):
        return ("PRE", "BIN") if t == "+" else ("PRE",)
    if t == "|":
        return ("BIN", "|")
    if t in ("/",):
        return ("BIN", "/")
    if t in ("//", "%", "&", "^", "<<", ">>", "<", ">", "<=", ">=", "==", "!="):
        return ("BIN",)
    if t in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="):
        return ("AUG",)
    return (t,)


_JAVA_KW = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split())
_JAVA_PRIM = frozenset("boolean byte char double float int long short".split())
_JAVA_MOD = frozenset("public private protected native strictfp transient volatile".split())
_JAVA_SOFT = {"record": "RECORD", "permits": "PERMITS", "yield": "YIELD", "when": "WHEN", "sealed": "SEALED", "non": "SEALED"}


def _java_terms(kind: str, t: str) -> tuple[str, ...]:
    if kind == "id":
        if t in ("true", "false", "null"):
            return ("LIT",)
        if t == "_":
            return ("ID",)
        if t in _JAVA_PRIM:
            return ("PRIM",)
        if t in _JAVA_MOD:
            return ("MOD",)
        if t in _JAVA_KW:
            return (t,)
        s = _JAVA_SOFT.get(t)
        return ("ID", s) if s else ("ID",)
    if kind in ("num", "str"):
        return ("LIT",)
    if t in ("++", "--"):
        return ("INCR",)
    if t in ("!", "~"):
        return ("PRE",)
    if t in ("+", "-"):
        return ("PRE", "BIN")
    if t in ("*",):
        return ("BIN", "*")
    if t in ("/", "%", "^", "<<", "<=", "==", "!=", "&&", "||"):
        return ("BIN",)
    if t in _ASSIGN:
        return ("ASSIGN",)
    return (t,)


_KT_KW = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split())
_KT_MOD = frozenset("public private protected internal abstract final open override sealed data enum annotation inner value inline noinline crossinline suspend operator infix external tailrec const lateinit vararg expect actual reified companion".split())
_KT_SOFT = {"by": "BY", "constructor": "CONSTRUCTOR", "init": "INIT", "where": "WHERE", "get": "GET", "set": "SET", "out": "OUT", "import": "IMPORT", "catch": "catch", "finally": "finally", "companion": "COMPANION", "suspend": "SUSPEND", "dynamic": "DYNAMIC"}


def _kt_terms(kind: str, t: str) -> tuple[str, ...]:
    if kind == "id":
        if t in ("true", "false", "null"):
            return ("LIT",)
        if t in ("package", "typealias"):
            return (t.upper(),)
        if t == "as":
            return ("AS",)
        if t in _KT_KW:
            return (t,)
        out = ["ID"]
        if t in _KT_MOD:
            out.append("MOD")
        if t in _KT_SOFT:
            out.append(_KT_SOFT[t])
        return tuple(out)
    if kind in ("num", "str"):
        return ("LIT",)
    if kind in ("sh", "sm", "st", "nl", "FILEANN", "LABEL", "ATLABEL"):
        return (kind.upper(),)
    if t in ("++", "--"):
        return (t, "PRE")
    if t in ("===", "!==", "==", "!=", "..<", "..", "<=", "?:", "||", "&&", "/", "%"):
        return ("BIN",)
    if t in ("+=", "-=", "*=", "/=", "%="):
        return ("ASSIGN",)
    if t == "?":
        return ("Q", "?")
    return (t,)


_RUST_KW = frozenset("as async await box break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while yield try do abstract become final macro override priv typeof unsized virtual".split()) - {"box"}
_RUST_SOFT = {"union": "UNION", "auto": "AUTO", "default": "DEFAULT", "safe": "SAFE"}


def _rust_terms(kind: str, t: str) -> tuple[str, ...]:
    if kind == "id":
        if t in ("true", "false"):
            return ("LIT", "ANY")
        if t == "_":
            return ("_", "ANY")
        if t in _RUST_KW:
            return (t, "ANY")
        s = _RUST_SOFT.get(t)
        return ("ID", s, "ANY") if s else ("ID", "ANY")
    if kind == "num":
        return ("LIT", "NUM", "ANY")
    if kind == "str":
        return ("LIT", "STR", "ANY")
    if kind == "life":
        return ("LIFE", "ANY")
    if kind == "LABEL":
        return ("LABEL", "ANY")
    if t in ("(", ")", "[", "]", "{", "}"):
        return (t,)
    if t in ("!", "-", "*", "&", "&&"):
        return (t, "PREX", "ANY")
    if t in ("..", "..=", "..."):
        return (t, "RANGE", "ANY")
    if t in ("/", "%", "^", "<<", "<=", "==", "!=") or t in _ASSIGN:
        return ("BIN", "ANY")
    return (t, "ANY")


#: Tokens after which a line end can't end a statement, and before which it can't.
_NO_END_AFTER = frozenset("( [ { , ; . ?. = == != === !== + * / % && || ?? ?: -> => :: < <= << & ^ ~ : .. ..< += -= *= /= %= ?".split())
_NO_END_BEFORE = frozenset(") ] , ; . ?. = == != === !== * / % && || ?? ?: -> => <= << & | ^ : += -= *= /= %= ? >= > :: as in instanceof".split())


def _line_ends(tokens: list, kotlin: bool) -> list:
    """Keeps the line ends that may end a statement; adds one before each `}` and at the end, where one is implied."""
    out: list = []
    after = _NO_END_AFTER | ({"<"} if not kotlin else set())
    before = _NO_END_BEFORE - {"in", "as", "*", "instanceof", "[", "?", "&", "<"}
    depth: list[str] = []
    pend = False
    for tok in tokens:
        kind, t, at = tok
        if kind == "com":
            continue
        if kind == "nl":
            pend = True
            continue
        if kind == "op" and t == "}" or kind in ("sm", "st"):
            pend = True
        if pend:
            inner = depth and depth[-1] in "(["
            if out and not inner and not (out[-1][0] == "op" and out[-1][1] in after) and out[-1][0] not in ("nl", "sh", "sm") and not (kind == "op" and t in before):
                out.append(("nl", "\n", at))
            pend = False
        if kind == "op":
            if t in "([{":
                depth.append(t)
            elif t in ")]}" and depth:
                depth.pop()
        elif kind == "sh":
            depth.append("[")
        elif kind == "st" and depth:
            depth.pop()
        out.append(tok)
    if out and out[-1][0] != "nl" and not (out[-1][0] == "op" and out[-1][1] == ";"):
        out.append(("nl", "\n", -1))
    return out


def _kotlin_labels(tokens: list) -> list:
    """Joins `name@` and `@name` after a jump, and `@file`, to one token each; adjacency counts."""
    out: list = []
    k, n = 0, len(tokens)
    while k < n:
        kind, t, at = tokens[k]
        nxt = tokens[k + 1] if k + 1 < n else ("", "", -1)
        if kind == "id" and nxt[1] == "@" and nxt[2] == at + len(t):
            after = tokens[k + 2] if k + 2 < n else ("", "", -1)
            if t in ("return", "break", "continue", "this", "super") and after[0] == "id" and after[2] == nxt[2] + 1:
                out += [tokens[k], ("ATLABEL", "@" + after[1], nxt[2])]
                k += 3
                continue
            if t not in _KT_KW:
                out.append(("LABEL", t + "@", at))
                k += 2
                continue
        if kind == "op" and t == "@" and nxt[1] == "file":
            out.append(("FILEANN", "@file", at))
            k += 2
            continue
        out.append(tokens[k])
        k += 1
    return out


def _rust_labels(tokens: list) -> list:
    out: list = []
    k, n = 0, len(tokens)
    while k < n:
        if tokens[k][0] == "life" and k + 2 < n and tokens[k + 1][1] == ":" and tokens[k + 2][1] in ("loop", "while", "for", "{"):
            if not (out and out[-1][1] in ("<", ",", "where")):
                out.append(("LABEL", tokens[k][1], tokens[k][2]))
                k += 2
                continue
        out.append(tokens[k])
        k += 1
    return out


def _prepared(language: str, text: str) -> list:
    if language == "python2":
        text, language = python2_tokens(text), "python"
    jsx = language.endswith("-jsx")
    language = language.split("-")[0]
    toks = lex(language, without_jsx(text, language == "typescript") if jsx else text)
    if language in ("javascript", "typescript"):
        return _line_ends(toks, False)
    if language == "kotlin":
        return _line_ends(_kotlin_labels(toks), True)
    if language == "rust":
        return _rust_labels([x for x in toks if x[0] not in ("com", "nl")])
    if language == "python":
        return [x for x in toks if x[0] != "com"]
    return [x for x in toks if x[0] not in ("com", "nl")]


def _py2_terms(kind: str, t: str) -> tuple[str, ...]:
    if kind == "id" and t in ("print", "exec"):
        return (t.upper(),)
    if kind == "id" and t in ("nonlocal", "async", "await"):
        return ("ID",)
    if kind == "op" and t == ">>":
        return ("BIN", ">>")
    return _py_terms(kind, t)


#: The current dialects of what an extension stands for, which run side by side on one sequence of tokens.
CURRENT = {"python": "python", "java": "java", "kotlin": "kotlin", "kotlin-script": "kotlin-script", "rust": "rust", "javascript": "javascript", "typescript": "typescript", "javascript-jsx": "javascript", "typescript-jsx": "typescript"}
#: Dialects that are supported besides, each on tokens of its own: earlier versions of a language, and extensions of it under its plain name.
BESIDES = {"python": ("python2",), "kotlin": ("kotlin-script",), "javascript": ("javascript-jsx",), "typescript": ("typescript-jsx",)}


@lru_cache(maxsize=None)
def dialects(language: str) -> list[tuple[str, Grammar, object]]:
    """(dialect, grammar, token -> terminals) of the dialects of a language that share its tokens."""
    if language == "python":
        return [("python3", Grammar(PYTHON, soft="NEVER"), lru_cache(20_000)(_py_terms))]
    if language == "python2":
        text = PYTHON
        for a, b in PYTHON2.items():
            assert a in text, a
            text = text.replace(a, b)
        return [("python2", Grammar(text, soft="NEVER"), lru_cache(20_000)(_py2_terms))]
    if language == "java":
        return [("java", Grammar(_sub(JAVA, MODULEKW="NEVER")), lru_cache(20_000)(_java_terms))]
    if language in ("kotlin", "kotlin-script"):
        text = _sub(KOTLIN, CLASSREF="NEVER").replace("Q2 = Q ;", "")
        if language == "kotlin-script":
            assert "(decl | ';' | NL)* ;\nend" in text
            text = text.replace("(decl | ';' | NL)* ;\nend", "stmts? ;\nend")
        return [(language, Grammar(text), lru_cache(20_000)(_kt_terms))]
    if language == "rust":
        return [("rust2021", Grammar(RUST.replace("LABEL2 = LIFE ':' ;", "").replace("PREX2 = '-' ;", "")), lru_cache(20_000)(_rust_terms))]
    ts = language == "typescript"
    return [(f"{language}-{'module' if m else 'script'}", _ecma(m, ts), lru_cache(20_000)(_ecma_terms(ts, m))) for m in (True, False)]


def accepting(language: str, text: str, besides: bool = False) -> list[str]:
    """The dialects that accept the text; empty if it has no tokens. `language` may be one of CURRENT.

    Those that share tokens run side by side. `besides` asks the dialects of BESIDES too.
    """
    try:
        found = together(_prepared(language, text), dialects(CURRENT[language]))
    except (LexError, NotJsx, RecursionError):
        found = []
    if besides:
        for other in BESIDES.get(language, ()):
            try:
                more = together(_prepared(other, text), dialects(CURRENT.get(other, other)))
            except (LexError, NotJsx, RecursionError):
                continue
            found += [name.replace(language, other, 1) if other.endswith("-jsx") else name for name in more]
    return found


def explain(language: str, text: str) -> str:
    """For people: where the furthest dialect stops."""
    try:
        toks = _prepared(language, text)
    except LexError as e:
        return f"tokens: {e}"
    best = max(((g.furthest([terms(k, t) for k, t, _ in toks]), name) for name, g, terms in dialects(CURRENT.get(language, language))), key=lambda x: x[0])
    k = best[0]
    if k > len(toks):
        return "ok"
    at = toks[k][2] if k < len(toks) else len(text)
    return f"{best[1]} stops at line {text.count(chr(10), 0, max(at, 0)) + 1}: {text[max(0, at - 60) : at]!r} >>> {text[at : at + 50]!r}"
