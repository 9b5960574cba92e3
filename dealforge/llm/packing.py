"""Operator 9: best-fit packing by linear grouping.

Documents become pieces of at most one sequence. How many pieces there are of each
length is all that the plan needs, a table of at most `capacity` rows. Large lengths
are put into groups of equal cardinality and rounded up to the largest of their
group, so that few sizes are left; full configurations of these sizes are chosen one
by one; the actual pieces take the slots; small pieces go into the tightest gap.
Pieces find their place by length and rank, in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealforge.llm.common import map_columns, read_table, scratch

CAPACITY = 4096
END_ID = 1
GROUPS = 32
#: Pieces of at most capacity / SMALL are small.
SMALL = 8
#: Ranks are counted within this many parts of each length.
RANK_PARTS = 1024
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
#: Signs that are taken off the end of a word; an apostrophe can begin a pre-token of letters.
SIGNS = "!#$%&()*+,-./:;=?@[]^_`{}~"

_tokenizers: dict = {}


class WordIds(dict):
    """The ids of a word, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it separates, so a text's
    ids are those of its words. New words are encoded many at a time: words of
    letters alone end where an id with the mark of a word's end stands, others are
    separated by a special token. The cache is emptied when full.
    """

    MARK, MARK_ID = "<|startoftext|>", 49406
    END = "</w>"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        import numpy as np

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        self.marked = self.tokenizer.token_to_id(self.MARK) == self.MARK_ID
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True

    def bytes_of(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def learn(self, new: set[str]) -> None:
        """Put words into the cache, through their lower-cased stems and the signs behind them.

        Letters and digits never share a pre-token with signs, so that the two parts
        can be encoded alone; a part is shared by many words.
        """
        if len(self) > CACHE_WORDS:
            self.clear()
            self.parts = {"": b""}
        words = list(new)
        low = [w.lower() if w.isascii() else w for w in words]
        stems = [x.rstrip(SIGNS) for x in low]
        stems = [s if s[-1:].isalnum() and "<|" not in s else x for s, x in zip(stems, low)]
        tails = [x[len(s) :] for s, x in zip(stems, low)]
        missing = [p for p in {*stems, *tails} if p not in self.parts]
        letters = [p for p in missing if p.isalpha()]
        for i in range(0, len(letters), 2000):
            self.learn_letters(letters[i : i + 2000])
        plain = [p for p in missing if self.marked and p not in self.parts and "<|" not in p and not p.isspace()]
        for i in range(0, len(plain), 500):
            group = plain[i : i + 500]
            ids = self.tokenizer.encode(f" {self.MARK} ".join(group), add_special_tokens=False).ids
            at = 0
            for p in group:
                end = ids.index(self.MARK_ID, at) if p is not group[-1] else len(ids)
                self.parts[p] = array("I", ids[at:end]).tobytes()
                at = end + 1
        for p in missing:
            if p not in self.parts:
                self.parts[p] = self.bytes_of(p)
        look = self.parts.__getitem__
        self.update(zip(words, map(add, map(look, stems), map(look, tails))))

    def learn_letters(self, group: list[str]) -> None:
        """Words of letters, each of which ends at one marked id; if the numbers differ, none is learned."""
        import numpy as np

        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) == len(group) and stops[-1] == 4 * len(ids):
            data = ids.tobytes()
            self.parts.update(zip(group, map(data.__getitem__, map(slice, [0, *stops], stops))))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.get, words)) for words in split]
        new = {w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None}
        if new:
            self.learn(new)
        return [b"".join(ids if None not in ids else [self[w] if x is None else x for w, x in zip(words, ids)]) for words, ids in zip(split, found)]


def word_ids(path: str | None) -> WordIds:
    """This worker's encoder for a tokenizer file (the public word_bpe_49k by default)."""
    if path not in _tokenizers:
        if path is None:
            import public_tokenizers

            _tokenizers[path] = WordIds(public_tokenizers.path(TOKENIZER))
        else:
            _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document: only one with more than capacity ids is cut."""

    def work(cols):
        out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        texts, step = [t or "" for t in cols["text"]], 256
        for k in range(0, len(texts), step):
            for doc_id, ids in zip(cols["doc_id"][k : k + step], word_ids(tokenizer).texts(texts[k : k + step])):
                ids += END_ID.to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for name, value in zip(out, (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
        return out

    return map_columns(docs.select("doc_id", "text"), work, PIECES)


def linear_groups(counts: dict[int, int], groups: int) -> list[list]:
    """[rounded size, items, queue of [length, how many]] of groups of equal cardinality, largest first."""
    total = sum(counts.values())
    out: list[list] = []
    share, filled = max(1, -(-total // groups)), 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not out or filled == share:
                if out and out[-1][0] == length:
                    share += left  # the next group would have the same size
                else:
                    out.append([length, 0, []])
                    share, filled = max(1, -(-total // groups)), 0
            n = min(left, share - filled)
            out[-1][1] += n
            out[-1][2].append([length, n])
            filled += n
            left -= n
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, the first that is left among them."""
    first = next(i for i, n in enumerate(left) if n)
    steps, reach = [], 1 << sizes[first]
    for i, (size, n) in enumerate(zip(sizes, left)):
        for _ in range(min(n - (i == first), capacity // size)):
            longer = (reach | reach << size) & ((1 << capacity + 1) - 1)
            if longer == reach:
                break
            steps.append((i, reach))
            reach = longer
    at, config = reach.bit_length() - 1, [0] * len(sizes)
    config[first] = 1
    for i, before in reversed(steps):
        if not before >> at & 1:
            config[i] += 1
            at -= sizes[i]
    return config


class Plan:
    """Runs of places: (length, first rank, pieces, pieces a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first sequence, how many) by gap
        self.order: list[int] = []
        self.large({x: n for x, n in counts.items() if x * small > capacity}, groups)
        for length in sorted((x for x in counts if x * small <= capacity), reverse=True):
            self.best_fit(length, counts[length])

    def run(self, length: int, n: int, each: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], n, each, first, offset))
        self.rank[length] += n

    def open(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if not self.gaps[gap]:
                bisect.insort(self.order, gap)
            self.gaps[gap].append((first, n))

    def large(self, counts: dict[int, int], groups: int) -> None:
        sizes = linear_groups(counts, groups)
        left = [n for _, n, _ in sizes]
        while any(left):
            config = fullest([s for s, _, _ in sizes], left, self.capacity)
            times = min(n // x for n, x in zip(left, config) if x)
            spans = [(self.sequences, times, 0)]  # first sequence, how many, used
            self.sequences += times
            for i, x in enumerate(config):
                left[i] -= x * times
                for _ in range(x):
                    spans = self.substitute(sizes[i][2], spans)
            for first, n, used in spans:
                self.open(self.capacity - used, first, n)

    def substitute(self, queue: list[list[int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Put one actual piece of a group into each sequence of spans."""
        out = []
        for first, n, used in spans:
            while n:
                length, there = queue[0]
                take = min(n, there)
                self.run(length, take, 1, first, used)
                out.append((first, take, used + length))
                first, n = first + take, n - take
                queue[0][1] -= take
                if not queue[0][1]:
                    queue.pop(0)
        return out

    def best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self.order, length)
            if at == len(self.order):
                new = -(-n // (self.capacity // length))
                self.open(self.capacity, self.sequences, new)
                self.sequences += new
                continue
            gap = self.order[at]
            first, m = self.gaps[gap].pop()
            if not self.gaps[gap]:
                self.order.pop(at)
            each, offset = gap // length, self.capacity - gap
            full = min(m, n // each)
            if full:
                self.run(length, full * each, each, first, offset)
                self.open(gap - each * length, first, full)
                first, m, n = first + full, m - full, n - full * each
            if m and 0 < n < each:
                self.run(length, n, n, first, offset)
                self.open(gap - n * length, first, 1)
                first, m, n = first + 1, m - 1, 0
            self.open(gap, first, m)


def with_rank(pieces: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """pieces with rank: 0, 1, ... among those of its length.

    A length that a third of all pieces share is counted in `parts` parts, and the
    parts' counts (at most parts a length) are summed.
    """
    cut = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "part").agg(F.count("*").alias("n")).select(F.col("length").alias("s_length"), F.col("part").alias("s_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside)
    return ranked.join(starts, (F.col("length") == F.col("s_length")) & (F.col("part") == F.col("s_part"))).withColumn("rank", F.col("base") + F.col("inside")).select(*pieces.columns, "rank")


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """sequence_id and offset of every piece, by its length and rank."""
    import numpy as np

    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    keys = runs[:, 0] << 48 | runs[:, 1]

    def work(cols):
        length, rank = np.array(cols["length"], dtype=np.int64), np.array(cols.pop("rank"), dtype=np.int64)
        run = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
        nth = rank - run[:, 1]
        return cols | {"sequence_id": run[:, 4] + nth // run[:, 3], "offset": run[:, 5] + nth % run[:, 3] * length}

    return map_columns(ranked, work, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is one piece with the end id. Every row of docs is packed,
    repeated ones as often as they occur; an empty table gives no rows; other columns
    are not read. The table of counts by length has at most `capacity` rows, whatever
    the corpus, and is all that comes to the driver.
    """
    pieces = scratch(pieces_of(docs, capacity, tokenizer))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(with_rank(pieces), Plan(counts, capacity))


def op9_best_fit_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
