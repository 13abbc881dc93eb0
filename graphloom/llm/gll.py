"""Generalised LL recognition over recursive transition networks with a graph-structured stack.

A grammar is a list of rules `name = body ;` in EBNF: quoted words and CAPITAL class names are terminals, small names are
rules, with | ( ) * + ?. Each rule becomes a deterministic automaton whose arrows are terminals or rules; left recursion and any
ambiguity are allowed, rules that match nothing are not. Descriptors (state, stack node) are worked off token by token; a stack
node is a rule called at a position, and its edges are the callers, so that all parses of a prefix share their stacks.
One token of lookahead (first and follow sets) keeps dead descriptors out.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s+|#[^\n]*|(?P<lit>'[^']*')|(?P<name>\w+)|(?P<p>[=;|()*+?])")


class Grammar:
    """A compiled grammar; `soft` is the terminal that any state may skip (an optional line end)."""

    def __init__(self, text: str, soft: str = "NL"):
        self.soft = soft
        toks = [(m.lastgroup, m.group()) for m in _LEX.finditer(text) if m.lastgroup]
        rules: dict[str, tuple] = {}
        k = 0
        while k < len(toks):
            name = toks[k][1]
            assert toks[k + 1][1] == "=", toks[k : k + 3]
            body, k = self._alt(toks, k + 2)
            assert toks[k][1] == ";", (name, toks[k : k + 4])
            assert name not in rules, name
            rules[name], k = body, k + 1
        self.names = list(rules)
        self._build(rules)

    def _alt(self, toks: list, k: int) -> tuple:
        alts = []
        while True:
            seq = []
            while toks[k][1] not in ("|", ")", ";") or toks[k][0] == "lit":
                kind, t = toks[k]
                if t == "(" and kind == "p":
                    x, k = self._alt(toks, k + 1)
                    assert toks[k][1] == ")"
                elif kind == "lit":
                    x = ("t", t[1:-1])
                else:
                    x = ("t", t) if t.isupper() else ("n", t)
                k += 1
                while toks[k][0] == "p" and toks[k][1] in "*+?":
                    x, k = (toks[k][1], x), k + 1
                seq.append(x)
            alts.append(("seq", seq))
            if toks[k][1] != "|":
                return (alts[0] if len(alts) == 1 else ("alt", alts)), k
            k += 1

    def _build(self, rules: dict) -> None:
        nfa: list[dict] = []  # label -> targets; None is the empty label

        def new() -> int:
            nfa.append({})
            return len(nfa) - 1

        def link(a: int, label, b: int) -> None:
            nfa[a].setdefault(label, []).append(b)

        def make(x: tuple, a: int, b: int) -> None:
            op = x[0]
            if op in ("t", "n"):
                link(a, x, b)
            elif op == "seq":
                for y in x[1]:
                    c = new()
                    make(y, a, c)
                    a = c
                link(a, None, b)
            elif op == "alt":
                for y in x[1]:
                    make(y, a, b)
            else:
                c, d = new(), new()
                link(a, None, c)
                make(x[1], c, d)
                link(d, None, b)
                if op in "*?":
                    link(a, None, b)
                if op in "*+":
                    link(d, None, c)

        def closure(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for y in nfa[todo.pop()].get(None, ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return frozenset(seen)

        dfa: list[dict] = []
        accept: list[bool] = []
        owner: list[str] = []
        start: dict[str, int] = {}
        for name, body in rules.items():
            a, b = new(), new()
            make(body, a, b)
            ids: dict[frozenset, int] = {}

            def state(s: frozenset) -> int:
                if s not in ids:
                    ids[s] = len(dfa)
                    dfa.append({})
                    accept.append(b in s)  # noqa: B023
                    owner.append(name)  # noqa: B023
                    todo.append(s)  # noqa: B023
                return ids[s]

            todo: list[frozenset] = []
            start[name] = state(closure([a]))
            while todo:
                s = todo.pop()
                moves: dict = {}
                for x in s:
                    for label, ys in nfa[x].items():
                        if label is not None:
                            moves.setdefault(label, set()).update(ys)
                for label, ys in moves.items():
                    dfa[ids[s]][label] = state(closure(ys))
            assert name == "file" or not accept[start[name]], f"{name} may be empty"
        first: dict[str, set] = {n: set() for n in rules}
        follow: dict[str, set] = {n: {"$"} for n in rules}
        changed = True
        while changed:
            changed = False
            for n in rules:
                for kind, x in dfa[start[n]]:
                    add = {x} if kind == "t" else first[x]
                    if not add <= first[n]:
                        first[n] |= add
                        changed = True
        changed = True
        while changed:
            changed = False
            for s, moves in enumerate(dfa):
                for (kind, x), to in moves.items():
                    if kind == "n":
                        add = set()
                        for kind2, y in dfa[to]:
                            add |= {y} if kind2 == "t" else first[y]
                        if accept[to]:
                            add |= follow[owner[s]]
                        if not add <= follow[x]:
                            follow[x] |= add
                            changed = True
        self.terminals = {x for m in dfa for k, x in m if k == "t"}
        #: state -> terminal -> (state after it or -1, ((rule's start, state after the rule), ...), whether the rule may end)
        self.acts: list[dict] = []
        for s, moves in enumerate(dfa):
            table: dict[str, list] = {}
            for (kind, x), to in moves.items():
                if kind == "t":
                    table.setdefault(x, [-1, [], False])[0] = to
                else:
                    for t in first[x]:
                        table.setdefault(t, [-1, [], False])[1].append((start[x], to))
            if accept[s]:
                for t in follow[owner[s]]:
                    table.setdefault(t, [-1, [], False])[2] = True
            self.acts.append({t: (a, tuple(b), c) for t, (a, b, c) in table.items()})
        self.start = start

    def furthest(self, tokens: list[tuple[str, ...]], rule: str = "file") -> int:
        """How many tokens some parse can begin with; len(tokens) + 1 if the whole is of the language."""
        run = Run(self, rule)
        for pos, terms in enumerate([*tokens, ("$",)]):
            run.step(terms)
            if not run.here:
                return len(tokens) + 1 if run.done else pos
        return len(tokens)

    def accepts(self, tokens: list[tuple[str, ...]], rule: str = "file") -> bool:
        return self.furthest(tokens, rule) == len(tokens) + 1


class Run:
    """A recognition under way: descriptors (state, stack node) after some tokens; `done` once the end was accepted."""

    def __init__(self, grammar: Grammar, rule: str = "file"):
        self.acts, self.soft = grammar.acts, grammar.soft
        self.root: list = []
        self.here = [(grammar.start[rule], self.root)]
        self.done = False

    def step(self, terms: tuple[str, ...]) -> None:
        """Takes one token, given by its terminals; `$` is the end."""
        acts, root = self.acts, self.root
        work, nodes, seen = self.here, {}, set()
        here, ahead = [], set()
        if self.soft in terms:
            here = list(work)
            ahead = {(s, id(x)) for s, x in here}
        while work:
            s, node = work.pop()
            table = acts[s]
            for t in terms:
                act = table.get(t)
                if act is None:
                    continue
                to, calls, end = act
                if to >= 0:
                    k = (to, id(node))
                    if k not in ahead:
                        ahead.add(k)
                        here.append((to, node))
                for begin, after in calls:
                    called = nodes.get(begin)
                    if called is None:
                        nodes[begin] = called = [(after, node)]
                        work.append((begin, called))
                    elif all(a != after or b is not node for a, b in called):
                        called.append((after, node))
                if end:
                    if node is root:
                        if t == "$":
                            self.here, self.done = [], True
                            return
                        continue
                    for edge in node:
                        k = (edge[0], id(edge[1]))
                        if k not in seen:
                            seen.add(k)
                            work.append(edge)
        self.here = here


def together(tokens: list, dialects: list[tuple[str, Grammar, object]]) -> list[str]:
    """The dialects that accept the tokens, all run side by side, a token at a time; one without descriptors left drops out."""
    runs = [(name, Run(g), terms) for name, g, terms in dialects]
    for kind, t, _ in tokens:
        for _, run, terms in runs:
            run.step(terms(kind, t))
        if not all(run.here for _, run, _ in runs):
            runs = [r for r in runs if r[1].here]
            if not runs:
                return []
    for _, run, _ in runs:
        run.step(("$",))
    return [name for name, run, _ in runs if run.done]
