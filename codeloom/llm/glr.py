"""A table-driven recogniser for any context-free grammar: generalised LR with tables built from productions.

`Tables` reads a grammar's productions, takes empty ones out, and builds the automaton of LR(0) item sets with follow sets
as lookahead. States and actions are built when a text first asks for them and are kept. `Parser` runs a stream of tokens
over these tables. Where a state has one move for a token the stack is a plain list; where it has several (a cast or a
parenthesis, a type argument or a comparison) the stacks go on side by side as a graph that shares what they have in
common, and those that meet a token they have no move for die out. A text is rejected at the first token that no stack
survives. The grammar's terminals are quoted signs and words and token classes in capitals.

Notation of productions, one a line (a line that begins with blanks goes on with the one before): `name: a | b`, groups
`( )`, `x?`, `x*`, `x+`, `x % s` (x one or more times with s between), `x %% s` (the same, s may follow the last), WORD
(a name or any keyword), ANY (any token but brackets).
"""

from __future__ import annotations

import itertools
import re

_PART = re.compile(r"'([^']+)'|([A-Za-z_]\w*)|(%%|[()|*+?%])")
BRACKETS = frozenset("()[]{}")
END = "$"


class _Reader:
    """Productions as lists of (symbol, may be left out)."""

    def __init__(self, text: str):
        self.rules: dict[str, list[list[tuple[str, bool]]]] = {}
        self.literals: set[str] = set()
        self.known: dict[str, str] = {}
        joined = re.sub(r"\n[ \t]+", " ", text)
        heads = [line.split(":", 1) for line in joined.split("\n") if line.strip()]
        self.names = {h.strip() for h, _ in heads}
        for head, body in heads:
            self.parts = [(m.lastindex, m[m.lastindex]) for m in _PART.finditer(body)]
            self.at = 0
            self.rules.setdefault(head.strip(), []).extend(self.alternatives())

    def peek(self, sign: str) -> bool:
        return self.at < len(self.parts) and self.parts[self.at] == (3, sign)

    def alternatives(self) -> list:
        out = [self.sequence()]
        while self.peek("|"):
            self.at += 1
            out.append(self.sequence())
        return out

    def sequence(self) -> list:
        out = []
        while self.at < len(self.parts) and self.parts[self.at] not in ((3, "|"), (3, ")")):
            out.append(self.item())
        return out

    def helper(self, key: str, rules: list) -> str:
        if key not in self.known:
            self.known[key] = name = f"_{len(self.known)}"
            self.rules[name] = [[x if x[0] != "@" else (name, False) for x in r] for r in rules]
        return self.known[key]

    def atom(self) -> tuple[str, bool]:
        kind, x = self.parts[self.at]
        self.at += 1
        if kind == 3:
            if x != "(":
                raise ValueError(f"{x!r} in a production")
            alts = self.alternatives()
            self.at += 1
            if len(alts) == 1 and len(alts[0]) == 1:
                return alts[0][0]
            return self.helper(repr(alts), alts), False
        if kind == 1:
            self.literals.add(x)
        return x if kind == 2 else "'" + x, False

    def item(self) -> tuple[str, bool]:
        x = self.atom()
        while self.at < len(self.parts) and self.parts[self.at][0] == 3 and self.parts[self.at][1] in ("*", "+", "?", "%", "%%"):
            sign = self.parts[self.at][1]
            self.at += 1
            if sign == "?":
                x = (x[0], True)
            elif sign in "*+":
                x = (self.helper(f"{x}+", [[(x[0], False)], [("@", False), (x[0], False)]]), sign == "*" or x[1])
            else:
                s = self.atom()
                some = self.helper(f"{x}%{s}", [[(x[0], False)], [("@", False), s, (x[0], False)]])
                x = (some, x[1]) if sign == "%" else (self.helper(f"{x}%%{s}", [[(some, False), (s[0], True)]]), x[1])
        return x


class Tables:
    def __init__(self, text: str, start: str, words: frozenset[str], extra: frozenset[str] = frozenset()):
        """words: the grammar's keywords; extra: terminals that only ANY needs."""
        r = _Reader(text)
        rules = r.rules
        terminals = {"'" + x for x in r.literals} | {s for alts in rules.values() for a in alts for s, _ in a if s not in rules and s not in ("WORD", "ANY")} | set(extra)
        rules["WORD"] = [[(w, False)] for w in sorted({"ID"} | {"'" + w for w in words})]
        rules["ANY"] = [[(t, False)] for t in sorted(terminals - {"'" + b for b in BRACKETS})]
        unknown = {s for alts in rules.values() for a in alts for s, _ in a if s not in rules and s not in terminals and not s.isupper() and s[0] != "'"}
        if unknown:
            raise ValueError(f"no production for {sorted(unknown)}")
        nullable: set[str] = set()
        while True:
            more = {n for n, alts in rules.items() if n not in nullable and any(all(o or s in nullable for s, o in a) for a in alts)}
            if not more:
                break
            nullable |= more
        rules["_start"] = [[(start, start in nullable), (END, False)]]
        flat: dict[tuple, None] = {}
        for name, alts in rules.items():
            for a in alts:
                for keep in itertools.product(*[((True, False) if o or s in nullable else (True,)) for s, o in a]):
                    body = tuple(s for (s, _), k in zip(a, keep, strict=True) if k)
                    if body and body != (name,):
                        flat[name, body] = None
        reach, todo = {"_start"}, ["_start"]
        of: dict[str, list[tuple]] = {}
        for name, body in flat:
            of.setdefault(name, []).append(body)
        while todo:
            for body in of.get(todo.pop(), ()):
                for s in body:
                    if s in of and s not in reach:
                        reach.add(s)
                        todo.append(s)
        # Items are numbers: position in one long list of symbols, in which each production ends with None.
        self.symbol: list[str | None] = []
        self.ends: dict[int, tuple[int, str]] = {}
        self.first_items: dict[str, list[int]] = {}
        for name in of:
            if name in reach:
                for body in of[name]:
                    self.first_items.setdefault(name, []).append(len(self.symbol))
                    self.symbol.extend(body)
                    self.ends[len(self.symbol)] = (len(body), name)
                    self.symbol.append(None)
        self.follow = self._follow({n: of[n] for n in of if n in reach})
        self.state_of: dict[tuple, int] = {}
        self.kernels: list[tuple] = []
        self.moves: list[dict | None] = []  # state → symbol → state
        self.reductions: list[list] = []
        self.actions: list[dict] = []
        self.start = self._state(tuple(self.first_items["_start"]))

    def _follow(self, of: dict) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {n: set() for n in of}
        follow: dict[str, set[str]] = {n: set() for n in of}
        for sets, step in ((first, "first"), (follow, "follow")):
            changed = True
            while changed:
                changed = False
                for n, bodies in of.items():
                    for b in bodies:
                        if step == "first":
                            new = first[b[0]] if b[0] in of else {b[0]}
                            if not new <= sets[n]:
                                sets[n] |= new
                                changed = True
                            continue
                        for x, y in zip(b, [*b[1:], None], strict=True):
                            if x in of:
                                new = follow[n] if y is None else first[y] if y in of else {y}
                                if not new <= follow[x]:
                                    follow[x] |= new
                                    changed = True
        return follow

    def _state(self, kernel: tuple) -> int:
        n = self.state_of.get(kernel)
        if n is None:
            n = self.state_of[kernel] = len(self.kernels)
            self.kernels.append(kernel)
            self.moves.append(None)
            self.reductions.append([])
            self.actions.append({})
        return n

    def _expand(self, state: int) -> dict:
        kernel = self.kernels[state]
        items, seen, todo = list(kernel), set(), list(kernel)
        while todo:
            s = self.symbol[todo.pop()]
            if s in self.first_items and s not in seen:
                seen.add(s)
                items += self.first_items[s]
                todo += self.first_items[s]
        by: dict[str, list[int]] = {}
        for i in items:
            s = self.symbol[i]
            if s is None:
                n, name = self.ends[i]
                self.reductions[state].append((n, name, self.follow[name]))
            else:
                by.setdefault(s, []).append(i + 1)
        m = self.moves[state] = {s: self._state(tuple(sorted(set(k)))) for s, k in by.items()}
        return m

    def moves_for(self, below: int, state: int, terms: tuple) -> tuple | None:
        """What a stack whose two topmost states are `below` and `state` may do at a token: (via, n, name) pops n symbols
        and pushes `name`, (via, 0, to) shifts to state `to`. `via` is the topmost state after the reductions of one
        symbol, which leave `below` as it is and are all done here. None if there is no move."""
        out, seen, todo = [], {state}, [state]
        while todo:
            s = todo.pop()
            m = self.moves[s] or self._expand(s)
            for term in terms:
                if term in m:
                    out.append((s, 0, m[term]))
            for n, name, after in self.reductions[s]:
                if not after.isdisjoint(terms):
                    if n > 1:
                        out.append((s, n, name))
                        continue
                    to = (self.moves[below] or self._expand(below))[name]
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        # Several states may shift or reduce alike; their order doesn't matter.
        return tuple(dict.fromkeys(out)) or None

    def goto(self, state: int, name: str) -> int:
        return (self.moves[state] or self._expand(state))[name]


class Parser:
    """Stacks as linked nodes [state, node below, other nodes below ...]. A head is a node with nothing reduced yet."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.known: dict[tuple, tuple | None] = {}  # (state below, state, terminals) → moves

    def begin(self) -> list:
        return [[self.t.start, [-1]]]

    def step(self, heads: list, terms: tuple) -> list:
        """The stacks after a token, which may be of several terminals; none if no stack has a move for it."""
        known, t = self.known, self.t
        if len(heads) == 1 and len(heads[0]) == 2:
            state, base = heads[0]
            while True:
                key = (base[0], state, terms)
                try:
                    moves = known[key]
                except KeyError:
                    moves = known[key] = t.moves_for(*key)
                if moves is None:
                    return []
                if len(moves) > 1:
                    return self._fork([(state, base)], terms)
                via, n, x = moves[0]
                if not n:
                    return [[x, [via, base]]]
                n -= 1
                below = base
                while n and len(below) == 2:
                    below = below[1]
                    n -= 1
                if n:
                    return self._fork([(state, base)], terms)
                m = t.moves[below[0]]
                state, base = (m if m is not None else t._expand(below[0]))[x], below
        return self._fork([(h[0], b) for h in heads for b in h[1:]], terms)

    def _fork(self, work: list, terms: tuple) -> list:
        """The same for several stacks: each (state, node below) is taken once, and those that shift alike meet."""
        known, t = self.known, self.t
        seen = {(s, id(b)) for s, b in work}
        via_nodes: dict[int, list] = {}
        shifted: dict[int, list] = {}
        for state, base in work:
            key = (base[0], state, terms)
            try:
                moves = known[key]
            except KeyError:
                moves = known[key] = t.moves_for(*key)
            if moves is None:
                continue
            for via, n, x in moves:
                if not n:
                    v = via_nodes.get(via)
                    if v is None:
                        v = via_nodes[via] = [via, base]
                    elif not any(y is base for y in v[1:]):
                        v.append(base)
                    to = shifted.get(x)
                    if to is None:
                        shifted[x] = [x, v]
                    elif not any(y is v for y in to[1:]):
                        to.append(v)
                    continue
                n -= 1
                below = base
                while n and len(below) == 2:
                    below = below[1]
                    n -= 1
                found = [below]
                while n:
                    found = list({id(y): y for z in found for y in z[1:]}.values())
                    n -= 1
                for b in found:
                    edge = ((t.moves[b[0]] or t._expand(b[0]))[x], id(b))
                    if edge not in seen:
                        seen.add(edge)
                        work.append((edge[0], b))
        return list(shifted.values())

    def run(self, tokens, mend: tuple = (), mends=None) -> tuple | None:
        """Runs over (terminals, ...) tokens and the end. None if they are accepted, else the first token that no stack
        survives (() for the end). Before a token that would be an error, and for which mends(token) holds, the
        terminals `mend` are tried."""
        known, moves_for, all_moves, expand, nothing = self.known, self.t.moves_for, self.t.moves, self.t._expand, ()
        state, base, heads = self.t.start, [-1], None
        for token in tokens:
            terms, shifted = token[0], False
            while heads is None:  # one stack, its topmost state apart
                key = (base[0], state, terms)
                moves = known.get(key, nothing)
                if moves is nothing:
                    moves = known[key] = moves_for(*key)
                if moves is None or len(moves) > 1:
                    break
                via, n, x = moves[0]
                if n == 0:
                    base, state, shifted = [via, base], x, True
                    break
                if n == 2:
                    if len(base) != 2:
                        break
                    below = base[1]
                else:
                    n -= 1
                    below = base
                    while n and len(below) == 2:
                        below = below[1]
                        n -= 1
                    if n:
                        break
                m = all_moves[below[0]]
                state, base = (m if m is not None else expand(below[0]))[x], below
            if shifted:
                continue
            now = heads if heads is not None else [[state, base]]
            after = self.step(now, terms)
            if not after:
                if mend and mends(token):
                    now = self.step(now, mend)
                    after = self.step(now, terms) if now else after
                if not after:
                    return token
            if len(after) == 1 and len(after[0]) == 2:
                (state, base), heads = after[0], None
            else:
                heads = after
        now = heads if heads is not None else [[state, base]]
        if state == self.t.start and base == [-1] or self.ends(now) or mend and self.ends(self.step(now, mend)):
            return None
        return ()

    def ends(self, heads: list) -> bool:
        return bool(heads) and bool(self.step(heads, (END,)))
