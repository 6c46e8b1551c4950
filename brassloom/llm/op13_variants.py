r"""Spelling variant grouping: words one edit apart, found over an index of grams of variable length.

Words are maximal runs ``[A-Za-zÀ-ÿ]+``, A-Z lower-cased, of at least ``LEAST`` code points
and with at least ``OCCURS`` occurrences. (For tests of recall the query first deletes a letter of
some runs, as its contract says: see ``damaged``.) Two words are near if they differ by exactly one
inserted, deleted or replaced code point.

1. Gram dictionary: grams begin with ``QMIN`` letters; one that more than some number of words hold is
   frequent, and is there only to be extended by a letter, up to ``QMAX``. So the dictionary is the
   set of frequent grams, which holds all their prefixes: a bounded table, as the number grows
   with the words.
2. Words of length c are compared with one another and with those of length c + 1 (visitors), in
   class c. There a word is decomposed: at each position the gram is extended as long as it is frequent and
   shorter than c // 2; a gram inside the one before is dropped.
3. How many grams of a word can one edit affect, at worst over all places? Those that hold the place, those left
   of it that may grow over it (or be swallowed by one that does), as far as the dictionary has what leads up to
   it, and those right of it that a new gram may swallow, as far as the dictionary has what it would end with. What is
   left, T, is a number of grams that any near word shares, at the same place from the left or the right.
4. List merging: a word stands in the lists (class, gram, place) of its rarest grams only, as many as are needed so
   that words which share T grams share one of these lists. Where an edit may affect all grams of both words, they meet
   in lists of one half of the word instead, which is a gram that one edit can't reach.
5. Lists longer than ``LONG`` are cut: near words in such a list are equal left of the shared gram or right of it, so
   the list is keyed by that side too, and then by halves of what is left, until lists are short. A list
   that can't be cut further has words which differ in one letter.
6. Words that share a list are verified.

A word's form is its near word with the most occurrences (ties: the smallest in code-point order), if it has at
least ``RATIO`` times as many. Forms are followed by doubling: each round halves the way to the root.

Counts are summed in tasks before they are shuffled. What goes to all tasks is the dictionary alone.

Edge cases: null texts and texts without letters have no words. A null doc_id counts as the empty
text where a run is damaged. Repeated rows count each time. Very long words are words like others. With no words there are no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.llm.common import FEW_IDS, discard, save, ship, small_batches, table

LEAST, OCCURS, RATIO = 5, 3, 2
#: One run in so many is damaged by the query.
DAMAGE = 97
QMIN, QMAX = 2, 6
#: Words that hold a frequent gram: so many at least, and a share of all gram positions, which bounds the dictionary at QMAX / SHARE grams.
FREQUENT, SHARE = 1000, 1 / 40_000
LONG = 1000
#: Distinct words that a task gathers before it hands them on.
FLUSH = 50_000
#: Pairs of letters that are compared at a time.
CELLS = 4_000_000
#: Words up to which a table of two words a row is broadcast.
FEW_WORDS = 200_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """All runs of a text in Latin-1, whose bytes are the code points; other letters separate runs."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(doc_id: object, found: Counter) -> Counter:
    """The runs of a document with their counts; those whose crc32 of ``<doc_id>:<run>`` is divisible by DAMAGE lose the letter at crc32 % length."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for word, n in found.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def words(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS, damage: bool = False) -> DataFrame:
    """Written (word, n) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in small_batches(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                # A shorter run can't become a word, as an edit deletes.
                found = Counter(w for w in runs(text) if len(w) >= least)
                held.update(damaged(doc_id, found) if damage else found)
            if len(held) > FLUSH:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    counted = rows.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    return save(counted.where(F.col("n") >= occurs), "variant-words")


def dictionary(found: DataFrame) -> dict[str, int]:
    """The frequent grams with the number of words' positions that have them."""
    positions = found.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = max(FREQUENT, int(positions * SHARE))
    out: dict[str, int] = {}
    shorter = shorter_table = None
    for q in range(QMIN, QMAX):
        grams = found.where(F.length("word") >= q).select(F.explode(F.expr(f"transform(sequence(1, length(word) - {q - 1}), p -> substring(word, p, {q}))")).alias("gram"))
        if shorter is not None:
            grams = grams.join(F.broadcast(shorter), F.substring("gram", 1, q - 1) == F.col("prefix"), "left_semi")
        table = save(grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > limit), "variant-grams")
        rows = table.collect()  # 1 / SHARE grams at most
        out |= {r.gram: r.n for r in rows}
        discard(shorter_table)
        shorter, shorter_table = table.select(F.col("gram").alias("prefix")), table
        if not rows:
            break
    discard(shorter_table)
    return out


class Grams:
    """Decomposition by a dictionary of frequent grams, and what an edit may affect."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        self.ends = {g[k:] for g in frequent for k in range(1, len(g))} | set(frequent)

    def of(self, word: str, cap: int) -> list[tuple[int, int]]:
        """(start, end) of the word's grams of at most cap letters, from left to right."""
        out, last, n = [], 0, len(word)
        for p in range(n - QMIN + 1):
            e = p + QMIN
            while e < n and e - p < cap and word[p:e] in self.frequent:
                e += 1
            if e > last:
                out.append((p, e))
                last = e
        return out

    def affected(self, word: str, cap: int, grams: list[tuple[int, int]]) -> int:
        """The greatest number of grams that an edit of one letter, at or before any position, may take away."""
        n, most = len(word), 0
        first = beyond = 0
        for i in range(n + 1):
            # The leftmost place from which a gram may reach over i after the edit.
            low = i
            for p in range(max(0, i - cap + 1), i):
                if i - p < QMIN or word[p:i] in self.frequent:
                    low = p
                    break
            while first < len(grams) and grams[first][0] < low:
                first += 1
            # The first gram right of i that no new gram over i can hold.
            beyond = max(beyond, first)
            while beyond < len(grams):
                p, e = grams[beyond]
                if p > i and (e - i > cap or (e - 1 - (i + 1) > 1 and word[i + 1 : e - 1] not in self.ends)):
                    break
                beyond += 1
            most = max(most, beyond - first)
        return most

    def chosen(self, word: str, cap: int) -> tuple[list[tuple[int, int]], bool]:
        """The rarest grams, in one of whose lists any near word is found; whether an edit may affect all grams, so that there are near words which share none."""
        grams = self.of(word, cap)
        shared = len(grams) - self.affected(word, cap, grams)
        grams.sort(key=lambda g: (self.frequent.get(word[g[0] : g[1]], 0), word[g[0] : g[1]], g[0]))
        return grams[: len(grams) - max(1, shared) + 1], shared < 1


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little", signed=True)


_LIST = "c int, key long, word string, n long, low int, high int, kind int"
#: What low and high enclose: the part that a list leaves open, or the gram that it fixes, beside which both sides, the right or the left one are open.
OPEN, BOTH, RIGHT, LEFT = range(4)


def lists(found: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """Written (c, key, word, n, low, high, kind) for each list that a word stands in: the class and the list's key, and what of the word is open there. A visitor is longer than c."""
    sent = found.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(sent.value)
        for batch in small_batches(batches):
            out = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for c in (len(word), len(word) - 1):
                    if c >= LEAST:
                        out += [(c, key, word, n, *at) for key, *at in _places(word, c, grams)]
            yield _batch(out)

    return save(found.select("word", "n").mapInArrow(run, _LIST), "variant-lists")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["c", "key", "word", "n", "low", "high", "kind"])


def _places(word: str, c: int, grams: Grams) -> list[tuple[int, int, int, int]]:
    """(key, low, high, kind) of each list of the word in class c."""
    best, uncertain = grams.chosen(word, c // 2)
    if len(word) == c:
        out = [(_key("gram", word[p:e], p), p, e, BOTH) for p, e in best]
    else:
        # Left of the edit a visitor's gram is where the shorter word has it, right of it one place further.
        out = [(_key("gram", word[p:e], p), p, e, RIGHT) for p, e in best] + [(_key("gram", word[p:e], p - 1), p, e, LEFT) for p, e in best if p]
    return out + (_halves(_key("word"), word, c, 0, len(word)) if uncertain else [])


def _halves(key: int, word: str, c: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """A list's open part in two, by the shorter word's measure: one edit leaves one of them as it is."""
    part = high - low - (len(word) - c)
    left, right = part // 2, part - part // 2
    return [(_key(key, "left", word[low : low + left]), low + left, high, OPEN), (_key(key, "right", word[high - right : high]), low, high - right, OPEN)]


def _shorter(key: int, word: str, c: int, low: int, high: int, kind: int) -> list[tuple[int, int, int, int]]:
    """The lists that take the place of a long one for a word in it."""
    if kind == OPEN:
        return _halves(key, word, c, low, high)
    out = [(_key(key, "before", word[:low]), high, len(word), OPEN)] if kind != LEFT else []
    return out + ([(_key(key, "after", word[high:]), 0, low, OPEN)] if kind != RIGHT else [])


def short_lists(rows: DataFrame) -> DataFrame:
    """rows with every list of more than LONG words cut into shorter ones, as far as words can be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield _batch([(c, to, word, n, *at) for c, key, word, n, low, high, kind in zip(*(x.to_pylist() for x in batch.columns)) for to, *at in _shorter(key, word, c, low, high, kind)])

    out, left = None, rows
    while True:
        can = F.when(F.col("kind") == OPEN, F.col("high") - F.col("low") - F.length("word") + F.col("c")).otherwise(2)
        over = save(left.groupBy("c", "key").agg(F.count("*").alias("size"), F.max(can).alias("open")).where((F.col("size") > LONG) & (F.col("open") > 1)).select("c", "key"), "variant-long")
        n = over.count()
        if not n:
            discard(over)
            return out.unionByName(left) if out is not None else left
        over = F.broadcast(over) if n <= FEW_IDS else over
        done, cut = left.join(over, ["c", "key"], "left_anti"), left.join(over, ["c", "key"], "left_semi")
        out = out.unionByName(done) if out is not None else done
        left = save(cut.select("c", "key", "word", "n", "low", "high", "kind").mapInArrow(run, _LIST), "variant-lists")


def near_words(rows: DataFrame) -> DataFrame:
    """Distinct (word, near, near_n), each pair both ways, of rows (c, key, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in small_batches(batches):
            held += zip(*(c.to_pylist() for c in batch.columns))
            # The last list may go on in the next batch.
            whole = len(held)
            while whole and held[whole - 1][:2] == held[-1][:2]:
                whole -= 1
            yield from out(held[:whole])
            held = held[whole:]
        yield from out(held)

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            for x, y in _near(rows[at][0], rows[at:to]):
                a, b = [rows[at + k] for k in x], [rows[at + k] for k in y]
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in a + b], pa.string()), pa.array([r[2] for r in b + a], pa.string()), pa.array([r[3] for r in b + a], pa.int64())], names=["word", "near", "near_n"])
            at = to

    placed = rows.select("c", "key", "word", "n").repartition("c", "key").sortWithinPartitions("c", "key")
    return placed.mapInArrow(run, "word string, near string, near_n long").distinct()


def _near(c: int, rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of near rows (c, key, word, n) of one class, sorted by key: words of length c with one another and with those of length c + 1 in their list."""
    length = np.array([len(r[2]) for r in rows])
    own, visit = np.flatnonzero(length == c), np.flatnonzero(length > c)
    if not len(own):
        return
    keys = np.array([r[1] for r in rows], np.int64)
    letters = lambda at, width: np.frombuffer("".join(rows[k][2] for k in at).encode("latin-1"), np.uint8).reshape(-1, width)
    a, v = letters(own, c), letters(visit, c + 1)
    begins, ends = np.searchsorted(keys[own], keys, "left"), np.searchsorted(keys[own], keys, "right")
    for i, j in _pairs(np.arange(1, len(own) + 1), ends[own], c):
        good = (a[i] != a[j]).sum(1) == 1
        yield own[i[good]], own[j[good]]
    for i, j in _pairs(begins[visit], ends[visit], c):
        same, moved = a[j] == v[i, :c], a[j] == v[i, 1:]
        ahead = np.where(same.all(1), c, same.argmin(1))
        behind = np.where(moved.all(1), c, moved[:, ::-1].argmin(1))
        good = ahead + behind >= c
        yield visit[i[good]], own[j[good]]


def _pairs(begins: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each i and begins[i] <= j < ends[i], in parts of bounded size."""
    many = np.maximum(ends - begins, 0)
    before = np.cumsum(many) - many
    most, at = max(1, CELLS // max(1, width)), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most)))
        i = np.repeat(np.arange(at, to), many[at:to])
        j = begins[i] + np.arange(len(i)) - (before[i] - before[at])
        for k in range(0, len(i), most):
            yield i[k : k + most], j[k : k + most]
        at = to


def roots(forms: DataFrame) -> DataFrame:
    """Written (word, root) of forms (word, form): the last word along the forms. Each round goes twice as far, and a form has more occurrences, so there are few."""
    up = save(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = up.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = save(up.join(_few(further), F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "variant-roots")
        discard(up)
        up = step
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_WORDS else df


def variants(found: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the words (word, n)."""
    ship(found.sparkSession)
    near = save(near_words(short_lists(lists(found, dictionary(found)))), "variant-near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likely = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    joined = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n"))
    joined = save(joined, "variant-forms")
    discard(near)
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents"), damage=True))


#: crc32's reversed polynomial is 3988292384; its table follows from it.
SQL = """
WITH RECURSIVE crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, run, COUNT(*)::BIGINT AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
b AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(COALESCE(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS h FROM b, crcs),
w AS (SELECT word, SUM(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING SUM(n) >= 3),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
k AS (SELECT word, near, near_n, COUNT(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS at FROM e),
f AS (SELECT w.word, w.n, COALESCE(k.n_near, 0)::BIGINT AS n_near, CASE WHEN k.near_n >= 2 * w.n THEN k.near END AS form, CASE WHEN k.near_n >= 2 * w.n THEN k.near_n END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND k.at = 1),
u AS (SELECT word, word AS root, form FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.form)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM f JOIN u ON u.word = f.word AND u.form IS NULL
"""
