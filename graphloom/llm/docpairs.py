"""Functions paired with their documentation: one recursive pattern per language takes comment, signature and balanced body together.

The body is matched ahead of the end of the match, so that functions within it are found too, and captured; bodies that are expressions
reach to the end of their statement.
"""

from __future__ import annotations

from functools import lru_cache
from textwrap import dedent

import regex

_STR = r"""(?<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_ECMA_DEF = r"""(?(DEFINE)
 (?<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\$]++|\\.|\$\{(?&inner)\}|\$)*+`)
 (?<com>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
 (?<rx>(?<=[=(,:;!&|?\[{}+\-*%<>~^]\s*|\b(?:return|typeof|case|in|of|void|delete)\s*)/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+)
 (?<inner>(?:[^(){}\[\]"'`/]++|(?&str)|(?&com)|(?&rx)|/|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
 (?<par>\((?&inner)\)) (?<body>\{(?&inner)\})
 (?<value>(?:[^(){}\[\]"'`/;,\n]++|(?&str)|(?&com)|(?&rx)|/|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\}|\n(?=\s*+[.?:&|+*<>=-])|(?<=[=+\-*/&|?:>.][ \t]*)\n)*+)
 (?<ang><(?:[^<>()\[\]{}"'`]++|(?<==)>|(?&ang)|(?&par)|(?&body)|\[(?&inner)\]|(?&str))*+>)
 (?<note>@[\w$]+(?:\.[\w$]+)*+(?&ang)?+\s*+(?&par)?+)
 (?<type>(?:[^(){}\[\]"'`=;,<>]|(?&str)|(?&par)|(?&ang)|\[(?&inner)\]|=>|(?&body)(?=\s*[\[|&{=])|(?<=[|&:]\s*)(?&body))+?)
 (?<id>\#?[\p{L}_$][\w$]*+)
)"""
_ECMA_SIG = r"""(?:
  (?:export\s++(?:default\s++)?+|declare\s++)*+(?:async\s++)?+function\s*+\*?+\s*+(?<name>(?&id))\s*+(?&ang)?+\s*+(?&par)\s*+(?::(?&type))?\s*+(?=(?<code>(?&body))|(?<code>;))
 |(?:export\s++)?+(?:const|let|var)\s++(?<name>(?&id))\s*+(?::(?&type))?=\s*+(?:async\b\s*+)?+(?:(?&ang)?+\s*+(?&par)\s*+(?::(?&type))?|(?&id)\s*+)=>\s*+(?=(?<code>(?&body))|(?<code>[^{](?&value)))
 |(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override)\s++)*+\*?+\s*+(?<name>(?!(?:if|for|while|switch|catch|function|return|with|do|else|await|yield|typeof|new|throw|super)\b)(?&id))\??+\s*+(?&ang)?+\s*+(?&par)\s*+(?::(?&type))?\s*+(?=(?<code>(?&body))|(?<code>;)(?<=:[^;]*))
)"""
_JAVA_DEF = r"""(?(DEFINE)
 (?<str>\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')
 (?<com>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
 (?<rx>(?!))
 (?<inner>(?:[^(){}\[\]"'/]++|(?&str)|(?&com)|/|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
 (?<par>\((?&inner)\)) (?<body>\{(?&inner)\})
 (?<ang><(?:[^<>(){}"']++|(?&ang))*+>)
 (?<note>@(?!interface\b)[\w$]+(?:\.[\w$]+)*+\s*+(?&par)?+)
 (?<id>[\p{L}_$][\w$]*+)
)"""
_JAVA_SIG = r"""(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp)\s++|(?&note)\s*+)*+(?:(?&ang)\s*+)?+(?!(?:new|return|else|throw|case|assert|record|class|yield)\b)
 (?&id)(?:\s*+\.\s*+(?&id))*+(?:\s*+(?&ang))?+(?:\s*+\[\s*\])*+\s++(?<name>(?!(?:if|for|while|switch|catch)\b)(?&id))\s*+(?&par)(?:\s*+\[\s*\])*+\s*+(?:throws\s[^{;]++)?+(?=(?<code>(?&body))|(?<code>;)|(?<code>default\b[^;]*+;?))"""
_KT_DEF = r"""(?(DEFINE)
 (?<str>\"\"\"(?:[^"$]++|\$\{(?&inner)\}|\$|"(?!""))*+\"\"\""*+|"(?:[^"\\\n$]++|\\.|\$\{(?&inner)\}|\$)*+"|'(?:[^'\\\n]|\\.)*+')
 (?<com>//[^\n]*+|/\*(?:[^*/]++|(?&nest)|\*(?!/)|/(?!\*))*+\*/) (?<nest>/\*(?:[^*/]++|(?&nest)|\*(?!/)|/(?!\*))*+\*/)
 (?<rx>`[^`\n]+`)
 (?<inner>(?:[^(){}\[\]"'/`]++|(?&str)|(?&com)|(?&rx)|/|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
 (?<par>\((?&inner)\)) (?<body>\{(?&inner)\})
 (?<value>(?:[^(){}\[\]"'/`;\n]++|(?&str)|(?&com)|(?&rx)|/|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\}|\n(?=\s*+(?:[.?:&|+*\-]|else\b))|(?<=[=+\-*/&|?:.][ \t]*)\n)*+)
 (?<ang><(?:[^<>(){}"']++|(?<=-)>|(?&ang)|(?&par))*+>)
 (?<note>@(?:\w+:)?[\w.]++(?&ang)?+(?&par)?+|@\w*:?\[(?&inner)\])
 (?<id>[\p{L}_]\w*+|`[^`\n]+`)
 (?<type>(?:[^(){}\[\]"'=;<>\n]|(?&par)|(?&ang)|->)+?)
)"""
_KT_SIG = r"""(?:(?:public|private|protected|internal|abstract|final|open|override|suspend|inline|operator|infix|external|tailrec|expect|actual)\s++|(?&note)\s*+)*+fun\s++(?:(?&ang)\s*+)?+
 (?:(?:(?&id)(?&ang)?+\?*+\.)*+)?+(?<name>(?&id))\s*+(?&par)\s*?(?::\s*(?&type))?(?:\s*+where\s[^{=]++)?+(?:\s*+(?=(?<code>(?&body))|(?<code>=(?&value)))|(?=(?<code>)(?:[ \t]*\n|[ \t]*\}|[ \t]*;|[ \t]*$)))"""
_RS_DEF = r"""(?(DEFINE)
 (?<str>\b(?:br|r|cr)(?<h>\#*+)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*+"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'|'[^\W\d]\w*+)
 (?<com>//[^\n]*+|/\*(?:[^*/]++|(?&nest)|\*(?!/)|/(?!\*))*+\*/) (?<nest>/\*(?:[^*/]++|(?&nest)|\*(?!/)|/(?!\*))*+\*/)
 (?<rx>(?!))
 (?<inner>(?:(?:[^(){}\[\]"'/rbc]|[rbc](?![\#"'r]))++|(?&str)|(?&com)|/|[rbc]|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
 (?<par>\((?&inner)\)) (?<body>\{(?&inner)\})
 (?<ang><(?:[^<>(){}\-=]++|(?<=[-=])>|[-=]|(?&ang)|(?&par)|(?&body))*+>)
 (?<note>\#!?\[(?&inner)\])
 (?<id>(?:r\#)?[\p{L}_]\w*+)
)"""
_RS_SIG = r"""(?:pub(?:\s*\([^)]*\))?\s++)?+(?:(?:const|async|unsafe|default|extern(?:\s*"[^"]*")?)\s++)*+fn\s++(?<name>(?&id))\s*+(?&ang)?+\s*+(?&par)\s*+(?:->(?:[^{;\[("']|(?&par)|\[(?&inner)\]|(?&str))++)?+(?=(?<code>(?&body))|(?<code>;))"""
_PY = r"""(?(DEFINE)
 (?<str>(?i:[rbuf]{0,3})(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
 (?<com>\#[^\n]*+)
 (?<inner>(?:[^(){}\[\]"'\#]++|(?&str)|(?&com)|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
 (?<par>\((?&inner)\))
 (?<line>(?:[^(){}\[\]"'\#\n\\]++|\\.|(?&str)|(?&com)|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})*+)
)
 (?:^(?<ind>[ \t]*+)(?<pre>(?:(?:(?&com)|@(?&line))[ \t]*+\n(?:[ \t]*+\n)*+[ \t]*+)*+)
 (?<sig>(?:async[ \t]++)?+def[ \t]++(?<name>[^\W\d]\w*+)\s*+(?:\[(?&inner)\])?+\s*+(?&par)\s*+(?:->(?:[^:\n(){}\[\]"']|(?&str)|\((?&inner)\)|\[(?&inner)\]|\{(?&inner)\})++)?+):
 (?=(?<body>(?&line)(?:\n(?:[ \t]*+(?:\#[^\n]*+)?+(?=\n|$)|(?P=ind)[ \t]++(?&line)))*+))
 |(?:[^"'\#\w\n]++|\w++(?!["']))++|(?&str)|(?&com)|\w++)"""
_PYDOC = regex.compile(r"""\s*+(?:\#[^\n]*+\s*+)*+(?i:r|u)?(?:\"\"\"(?<d>(?:[^\\"]|\\.|"(?!""))*+)\"\"\"|'''(?<d>(?:[^\\']|\\.|'(?!''))*+)'''|"(?!"")(?<d>(?:[^"\\\n]|\\.)*+)"|'(?!'')(?<d>(?:[^'\\\n]|\\.)*+)')""", regex.S | regex.X)

_LANGS = {"javascript": (_ECMA_DEF, _ECMA_SIG), "typescript": (_ECMA_DEF, _ECMA_SIG), "java": (_JAVA_DEF, _JAVA_SIG), "kotlin": (_KT_DEF, _KT_SIG), "rust": (_RS_DEF, _RS_SIG)}


@lru_cache(maxsize=None)
def pattern(language: str) -> regex.Pattern:
    """Comments and annotations, then signature, then (ahead) the balanced body; else a string, a comment or a word to step over."""
    if language == "python":
        return regex.compile(_PY, regex.X | regex.S | regex.M)
    define, sig = _LANGS[language]
    skip = r"(?:[^\"'/@\#\w]++|\w++(?![\"'\#]))++" if language == "rust" else r"[^\"'`/@\#]++"  # where nothing of interest begins
    return regex.compile(define + r"(?:(?<pre>(?=/|[@\#])(?:(?:(?&com)|(?&note))\s*+)++)(?<sig>" + sig + r")|" + skip + r"|(?&str)|(?&com)|(?&rx)|\w++)", regex.X | regex.S)


_PIECE = {k: regex.compile(d + r"(?<com1>(?&com))|(?<note1>(?&note))|(?<gap>\s++)", regex.X | regex.S) for k, (d, _) in _LANGS.items()}
_BLANK = regex.compile(r"\n[ \t\r]*\n")


def _own_comments(language: str, pre: str, own_line: bool) -> str:
    """The comments of `pre` after its last blank line; the first only if it begins its line."""
    parts: list[str] = []
    for m in _PIECE[language].finditer(pre):
        if m["gap"] is not None:
            if m["gap"].count("\n") > 1:
                parts, own_line = [], True
        elif m["com1"] is not None:
            if own_line or parts or "\n" in pre[: m.start()]:
                parts.append(m["com1"])
    return "\n".join(parts)


def _shifted(text: str, m: regex.Match) -> str:
    """Signature and body, moved to the left by what the signature's line is indented."""
    at = m.start("sig")
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return dedent(line[: len(line) - len(line.lstrip())] + text[at : m.end("code")]).rstrip()


def functions(language: str, text: str) -> list[dict]:
    """Every named function with a comment or docstring: name, line, kind, signature, raw documentation, code."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    out = []
    if language == "python":
        for m in pattern(language).finditer(text):
            if m["name"] is None:
                continue
            pre = m["pre"]
            keep: list[str] = []
            for line in pre.split("\n")[:-1]:
                s = line.strip()
                if not s:
                    keep = []
                elif s[0] == "#":
                    keep.append(s)
            d = _PYDOC.match(m["body"])
            docs = ["\n".join(keep)] if keep else []
            if d:
                docs.append('"""' + d["d"])
            if docs:
                out.append({"name": m["name"], "line": text.count("\n", 0, m.start("name")) + 1, "kind": "python_method" if m["ind"] else "python_function", "signature": m["sig"], "docs": docs, "code": dedent(m["ind"] + text[m.start("sig") : m.end("body")]).rstrip()})
        return out
    for m in pattern(language).finditer(text):
        name = m["name"]
        if name is None:
            continue
        at = m.start()
        own = not text[text.rfind("\n", 0, at) + 1 : at].strip()
        doc = _own_comments(language, m["pre"], own)
        if doc:
            out.append({"name": name.strip("`"), "line": text.count("\n", 0, m.start("name")) + 1, "kind": {"kotlin": "kotlin_function", "rust": "rust_function"}.get(language, "method" if language == "java" else "function"), "signature": m["sig"].rstrip(), "docs": [doc], "code": _shifted(text, m)})
    return out


# What a line of documentation may be besides description: fixed word lists and forms.
_DIRECTIVE = regex.compile(r"(?:eslint|tslint|jshint|jslint|pylint|flake8|mypy|ruff|noqa|nosec|nosonar|noinspection|type:\s*ignore|pyright|isort|fmt:|yapf|prettier|istanbul|c8 ignore|v8 ignore|@ts-|@flow|@formatter|formatter:|checkstyle|spotless|rustfmt|clippy|ktlint|detekt|pragma|sonar|codecov|lgtm|coverage|biome|webpack|language=|@?suppress|region\b|endregion\b|cspell|spell-?checker|vim:|-\*-|global\s|exported\s|globals\s|jscpd|deno-lint|lint\b|allow\(|#\[)", regex.I)
_TODO = regex.compile(r"(?:@?(?:todo|fixme|xxx|hack|wip|tbd|tbc)\b)", regex.I)
_PLACE = regex.compile(r"(?:documentation goes here|lorem ipsum|auto-?generated|add (?:a )?(?:description|docs?|documentation)|description (?:goes )?here|\{@inheritdoc\}|see above|see below|insert |fill (?:this |me )?in|placeholder|write (?:the )?(?:docs?|documentation|me)|no (?:description|documentation)|missing (?:docs?|documentation)|undocumented|not (?:yet )?documented|your (?:description|documentation)|describe (?:this|the) (?:function|method)|to be (?:written|documented|done|filled|added))", regex.I)
_TAG = regex.compile(r"[@\\](?:param|params|arg|argument|return|returns|throws|throw|exception|raises|yields?|property|prop|type|typedef|template|receiver|tparam|see|since|author|version|deprecated|example|default|link|override|inheritdoc|public|private|protected|internal|async|static|readonly|memberof|class|function|method|name|callback|fires|emits|constructor|sample|suppress|api\w*|\w+)\b", regex.I)
_SPHINX = regex.compile(r":(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|meta)\b[^:\n]*:", regex.I)
_SECTION = regex.compile(r"(?:\#+\s*)?(?:args|arguments|parameters?|params|keyword args|keyword arguments|other parameters|returns?|yields?|raises?|throws|errors?|panics?|safety|attributes|examples?|usage|see also|notes? to self|type parameters|receives|warns|references)\s*:?\s*$", regex.I)
_INLINE = regex.compile(r"(?:args|arguments|parameters?|params|returns?|yields?|raises?|throws|return value)\s*:\s+\S", regex.I)
_ITEM = regex.compile(r"(?:[*\-+]\s+)?(?:`[^`]+`|\*{0,2}[A-Za-z_$][\w$]*(?:\s*\([^)]*\))?)\s*(?:[:\-–—])\s*\S")
_CODE = regex.compile(r"(?:.*[;{}]\s*$|(?:[\w$.\[\]]|::)+\s*(?:[-+*/|&]?=(?!=)|:=)\s*\S.*|(?:await\s+|return\s+|print\s*)?[\w$.:!]+\(.*\)\s*[;.?,]?$|(?:return|throw|raise|del|break|continue|import|from|use|package|let|const|var|val|def|fn|fun|function|class|elif|else)\b(?!\s+(?:the|an?|of|from|to|if|when|with|all|every|each|its|this|that|whether)\b)[^.]*[=();:\[\]{}<>]\S*.*|(?:if|for|while|switch|catch|with)\s*\(.*|(?:if|for|while|with|elif)\b.*:\s*$|@\w+(?:\(.*\))?$|</?\w+[^>]*>\s*$|[)\]}]+[;,]?|.*(?:=>|->|&&|\|\||===|!==|==|!=|\+=|\+\+).*)", regex.S)
_WORD = regex.compile(r"\p{Han}|[\p{Hiragana}\p{Katakana}]{2}|\p{Hangul}+|[\p{L}\p{N}][\p{L}\p{M}\p{N}'’\-_]*")
_LETTER = regex.compile(r"\p{L}")
_CAMEL = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{Lo}+")


def _stem(w: str) -> str:
    w = w.lower().strip("'’-_")
    for end in ("ies", "es", "s"):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)] + ("y" if end == "ies" else "")
    return w


def _lines(doc: str) -> list[str]:
    """The documentation without its comment marks; indentation within it is kept."""
    if doc.startswith('"""'):
        body = doc[3:]
        first, _, rest = body.partition("\n")
        return [first.strip(), *dedent(rest).split("\n")]
    out = []
    for piece in regex.split(r"(?<=\*/)\s*\n?", doc) if "/*" in doc else [doc]:
        for line in piece.split("\n"):
            s = line.strip()
            s = regex.sub(r"^/\*+!?", "", s)
            s = regex.sub(r"\*+/$", "", s)
            s = regex.sub(r"^(?://+!?|\*+(?!\S*\*)|\#+!?(?=\s|$|\w))", "", s) if not line.lstrip().startswith("/*") else s
            out.append(s[1:].rstrip() if s[:1] == " " else s.rstrip())
    return out


def description(doc: str) -> str:
    """The lines of `doc` that describe: no entries of parameters and returns, notes to do, placeholders, directives or code."""
    keep: list[str] = []
    lines = _lines(doc)
    entry = section = gap = False
    depth = 0
    fence = False
    for raw in lines:
        s = raw.strip()
        ind = len(raw) - len(raw.lstrip())
        if s.startswith("```") or s.startswith("~~~"):
            fence = not fence
            continue
        if fence or s.startswith(">>>"):
            continue
        if not s:
            gap = True
            keep.append("")
            continue
        if regex.fullmatch(r"[\W_]+", s):
            continue
        if _TAG.match(s) or _SPHINX.match(s):
            entry, section, gap, depth = True, False, False, ind
            if regex.match(r"[@\\](?:brief|summary|description|desc|remarks?|details?|note)\b", s):
                entry = False
                keep.append(regex.sub(r"^[@\\]\w+", "", s))
            continue
        if _SECTION.fullmatch(s):
            section, entry, gap, depth = True, True, False, ind
            continue
        if _INLINE.match(s):
            entry, section, gap, depth = True, False, False, ind
            continue
        if section:
            if not gap or ind > depth or _ITEM.match(s):
                continue
            section = entry = False
        elif entry:
            if not (gap and ind <= depth):
                continue
            entry = False
        if _TODO.match(s):
            continue
        if _DIRECTIVE.match(s) or _PLACE.match(s.strip("*_ .")) or _CODE.fullmatch(s):
            continue
        keep.append(s)
    text = " ".join(x for x in keep if x)
    return regex.sub(r"\{@\w+[^}]*\}|</?\w+[^>]*>|`[^`]*\([^`]*`|https?://\S+", " ", text)


def words(doc: str, name: str) -> int:
    """Words of description in `doc` that do not repeat the function's name."""
    own = {_stem(w) for w in _CAMEL.findall(name)} | {name.lower()}
    n = 0
    for w in _WORD.findall(description(doc)):
        if _LETTER.search(w) and _stem(w) not in own:
            n += 1
    return n


LEAST_WORDS = 5


def documented(language: str, text: str, least: int = LEAST_WORDS) -> list[dict]:
    """The functions whose documentation holds at least `least` words of description."""
    out = []
    for f in functions(language, text):
        good = [d for d in f["docs"] if words(d, f["name"]) >= least]
        if good:
            out.append(f | {"docstring": "\n".join(x for x in _lines(good[-1])).strip()})
    return out
