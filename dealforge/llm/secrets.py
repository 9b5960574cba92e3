"""Operator 3: secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query of the trigrams that any match must
contain. Documents are indexed in segments (one Arrow batch each, as search engines
keep theirs): one pass over the bytes of each text finds which of the asked trigrams
it holds and adds it to their postings. A rule's query is answered by intersecting
and uniting postings, and its regex runs over the candidates only. A rule without a
mandatory trigram scans its whole segment.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product

from dealforge.llm.common import map_columns, read_table

MAX_STRINGS = 24
#: Bytes of a text that are read at once.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    flags: int = 0
    #: Least length of group; a shorter match is dropped.
    group: int = 0
    least: int = 1


#: The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 0, 16),
)
#: Further kinds of credentials with published formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"://[^\s/:@]*:[^\s/@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def both(a, b):
    """The query that asks for a and b; None asks for nothing."""
    return b if a is None else a if b is None else ("and", a, b)


def either(queries):
    """The query that asks for one of several; None if one of them asks for nothing."""
    queries = list(queries)
    return None if None in queries or not queries else queries[0] if len(queries) == 1 else ("or", *queries)


def of_string(s: str):
    """All trigrams of a string; other letters than those of ASCII, whose case the index does not fold, ask for nothing."""
    out = None
    for i in range(len(s) - 2):
        out = both(out, s[i : i + 3] if s[i : i + 3].isascii() else None)
    return out


def asked_by(query) -> set[str]:
    """The trigrams of a query."""
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(asked_by, query[1:]))


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean trigram query of a regex over lower-cased text, or None.

    Literal stretches, with their small alternatives, give strings; every string
    its trigrams. Whatever else stands between only breaks the stretches.
    """

    def strings_of(seq):
        """The strings that seq can be, if few, else None; and a query any match meets."""
        exact, query, whole = {""}, None, True

        def flush():
            nonlocal exact, query
            query = both(query, either(map(of_string, sorted(exact))))
            exact = {""}

        for op, arg in seq:
            op, options, asked = str(op), None, None
            if op == "LITERAL":
                options = {chr(arg).lower()}
            elif op == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
                options = {chr(c).lower() for _, c in arg}
            elif op == "SUBPATTERN":
                options, asked = strings_of(arg[-1])
            elif op == "BRANCH":
                parts = [strings_of(branch) for branch in arg[1]]
                options = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
                asked = either(p[1] if p[0] is None else either(map(of_string, sorted(p[0]))) for p in parts)
            elif op == "MAX_REPEAT":
                low, high, sub = arg
                options, asked = strings_of(sub)
                if options is not None and int(high) == 1:
                    options = options | ({""} if low == 0 else set())
                elif options is not None and low == int(high) <= 8:
                    options = {"".join(p) for p in product(sorted(options), repeat=low)} if len(options) ** low <= MAX_STRINGS else None
                else:
                    asked = None if low == 0 else asked if options is None else either(map(of_string, sorted(options)))
                    options = None
            if options is not None and len(exact) * len(options) <= MAX_STRINGS:
                exact = {a + b for a in exact for b in options}
            else:
                flush()
                whole = False
                if options is not None:
                    exact = set(options)
                else:
                    query = both(query, asked)
        if whole:
            return exact, None
        flush()
        return None, query

    exact, query = strings_of(re._parser.parse(pattern, flags))
    return query if exact is None else either(map(of_string, sorted(exact)))


_asked: dict = {}


def trigram_codes(text: str, asked: tuple[int, ...]):
    """The codes, among those asked for, of a text's trigrams of bytes (A-Z lower-cased), by stretches."""
    import numpy as np

    if asked not in _asked:
        table = np.zeros(1 << 24, dtype=bool)
        table[list(asked)] = True
        _asked[asked] = table
    data, found = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8), set()
    for at in range(0, len(data) - 2, STRETCH):
        part = data[at : at + STRETCH + 2].astype(np.uint32)
        codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        found.update(codes[_asked[asked][codes]].tolist())
    return found


class Segment:
    """An inverted index of some texts: the postings of the trigrams that queries ask for."""

    def __init__(self, texts: list[str], asked: set[str]):
        self.n, postings = len(texts), {trigram: [] for trigram in asked}
        code = {int.from_bytes(t.encode(), "big"): t for t in asked}
        for i, text in enumerate(texts):
            for c in trigram_codes(text, tuple(code)):
                postings[code[c]].append(i)
        self.postings = {trigram: frozenset(found) for trigram, found in postings.items()}

    def matches(self, query) -> frozenset[int] | range:
        """The documents that meet a query: all of them if it is None."""
        if query is None:
            return range(self.n)
        if isinstance(query, str):
            return self.postings[query]
        kind, *parts = query
        out = self.matches(parts[0])
        for part in parts[1:]:
            if kind == "and":
                out = out & self.matches(part) if out else out
            else:
                out = out | self.matches(part)
        return out


def scan_texts(texts: list[str], rules=RULES) -> list[list[tuple[str, int, int]]]:
    """The (kind, start, end) of each text, by start and then in order of the rules."""
    queries, found = [trigram_query(rule.pattern, rule.flags) for rule in rules], [[] for _ in texts]
    segment = Segment(texts, set().union(*map(asked_by, queries)))
    for rank, (rule, query) in enumerate(zip(rules, queries)):
        regex = re.compile(rule.pattern, rule.flags)
        for i in sorted(segment.matches(query)):
            found[i] += [(m.start(), rank, m.end()) for m in regex.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [[(rules[k].name, start, end) for start, k, end in sorted(x)] for x in found]


def scan_secrets(docs, rules=RULES):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs.

    spans lists kind:start:end of every rule's matches, in code points; base_sha256
    is of the base kinds' list alone. A null or empty text has no spans (the digest
    of the empty list); repeated rows get equal results, an empty table none, null ids
    stay null; a very long text is scanned whole; other columns are not read. Matches of one rule do not overlap, those of several may.
    """
    base = [r.name for r in BASE_RULES]

    def work(cols):
        spans = scan_texts([t or "" for t in cols["text"]], rules)
        listed = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        return {
            "doc_id": cols["doc_id"],
            **{f"n_{kind}": [sum(k == kind for k, _, _ in x) for x in spans] for kind in base},
            "base_sha256": [hashlib.sha256(listed([s for s in x if s[0] in base]).encode()).hexdigest() for x in spans],
            "spans": [listed(x) for x in spans],
        }

    return map_columns(docs.select("doc_id", "text"), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secret_scans(spark, sf_dir):
    return scan_secrets(read_table(spark, sf_dir, "documents"))
