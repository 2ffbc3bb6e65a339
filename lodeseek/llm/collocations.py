"""Collocations: frequent word phrases of every language, mined over vertical positional inverted lists.

Documents become *segments*: what one task reads until it has ``SEGMENT_WORDS`` words. In a segment every word
occurrence has a place; pieces and documents leave a place free between them, so neighbours in a piece, and only they,
are at consecutive places. A word's list in a segment is its places there, packed as differences, in one row of a
written table; the sum of its lists' lengths is its exact frequency.

Phrases grow level by level. Only words that are frequent in the whole corpus keep their lists, under a number. In each
segment the lists are merged in the order of their places; an occurrence meets the occurrence at the next place, and
the places where two items meet are the list of the longer phrase. Items of m words that meet at neighbouring places
overlap in m - 1 words, so a phrase of m + 1 words is a pair of numbers: its first and its last m words, both of which
are frequent. All lists of a segment whose phrases begin with the same word are one row, so that there are no more rows than
(segment, word) pairs, however many phrases there are. These rows are dealt out by their word, a common word's by parts of
its phrases, so that a group holds some ``GROUP`` occurrences; there the lengths of the lists add up to exact
frequencies, the frequent phrases get numbers, and their lists alone go back to their segments for the next level.

A phrase carries the frequencies of its heads and tails from the levels below, so its cuts need no further joins.
Scores are whole divisions of decimals of 38 digits: exact for frequencies up to 10**16.

Defined results: null texts are empty; a null language is ``und``; words that stand at the end of a piece or document
form no phrase with what follows; repeated rows, also of one id, count each time; a very long text is one document of
one segment, however long, and is never cut; ties are ordered by frequency, then by the bytes of the phrase; a language
without frequent phrases has no row; an empty table gives an empty result; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import Work, column_bytes, mix64
from lodeseek.llm.decontamination import unpacked

#: A-Z in lower case, a tab as a space, what ends a piece as a line feed.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))
#: Words after which a segment ends with its document; occurrences of phrases of one first word that meet in a task.
SEGMENT_WORDS, GROUP = 2_000_000, 500_000
#: Rows of a batch that leaves a task; rows whose phrases are counted at a time, in whole words.
ROWS, TOGETHER = 50_000, 20_000


class Numbers:
    """Numbers of words, one counter for all languages; 0 is no word, 1 a free place."""

    def __init__(self):
        self.of: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = [("", b""), ("", b"")]

    def lookup(self, lang: str):
        words, every = self.of.setdefault(lang, Language()), self.words
        words.lang, words.every = lang, every
        return words.__getitem__


class Language(dict):
    """The numbers of one language's words."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.every)
        self.every.append((self.lang, word))
        return n


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2**63 as bytes of seven bits, the highest bit set where another byte follows; and their ends."""
    size, top = np.ones(len(numbers), np.int64), int(numbers.max()) if len(numbers) else 0
    for j in range(1, -(-top.bit_length() // 7)):
        size += numbers >= 1 << 7 * j
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max()) if len(size) else 0):
        has = size > j
        out[(ends - size)[has] + j] = (numbers[has] >> 7 * j & 127) | ((size[has] > j + 1) << 7)
    return out, ends


def steps_of(numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences in lists that begin there, the first number of each as it is; lists ascend."""
    steps = np.diff(numbers, prepend=0)
    steps[begins] = numbers[begins]
    return steps


def sums_of(steps: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers again."""
    total = np.cumsum(steps)
    return total - np.repeat(total[begins] - steps[begins], lengths)


def binary(numbers: np.ndarray, ends: np.ndarray):
    """A binary column whose rows hold the numbers up to these ends, as varints."""
    import pyarrow as pa

    data, byte_ends = varints(numbers)
    at = np.concatenate([[0], byte_ends])[np.concatenate([[0], ends])]
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def numbers_of(column) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    return unpacked(column_bytes(column)[0])


def begins_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def word_lists(docs: DataFrame, segment_words: int) -> DataFrame:
    """segment, lang, word, n, places for every word of every segment of docs (lang, text as bytes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32

        def flush(numbers: Numbers, parts: list[np.ndarray]) -> Iterator:
            flat = np.concatenate(parts)
            order = np.argsort(flat, kind="stable")
            count = np.bincount(flat, minlength=len(numbers.words))[2:]
            places = order[np.searchsorted(flat[order], 2) :]
            if not len(places):
                return
            steps, ends = steps_of(places, begins_of(count)), np.cumsum(count)
            for a in range(0, len(count), ROWS):
                z = min(a + ROWS, len(count))
                first = int(ends[a] - count[a])
                langs, words = zip(*numbers.words[2 + a : 2 + z], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, segment)), pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(count[a:z]), binary(steps[first : int(ends[z - 1])], ends[a:z] - first)], names=["segment", "lang", "word", "n", "places"])

        numbers, parts, total = Numbers(), [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_buffer().to_pybytes().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
                found = np.fromiter(map(numbers.lookup(lang), words), np.int32, len(words))
                # a free place follows the document
                parts += [found[found != 0], np.ones(1, np.int32)]
                total += len(parts[-2])
                if total >= segment_words:
                    yield from flush(numbers, parts)
                    numbers, parts, total, segment = Numbers(), [], 0, segment + 1
        if parts:
            yield from flush(numbers, parts)

    return docs.mapInArrow(run, "segment long, lang string, word binary, n long, places binary")


#: Lists of one segment whose phrases begin with one word (first, of frequency f): ids of the phrases, lengths and places of their lists.
LISTS = "segment long, first long, f long, ids binary, lengths binary, places binary"
#: The same where items meet: left and right are what has met; part: of the phrases of a common first word.
MET = "first long, part int, segment long, f long, `left` binary, `right` binary, lengths binary, places binary"
#: What counting finds: a frequent phrase (left, right, n, id), or lists of frequent phrases that go back to a segment.
COUNTED = "`left` long, `right` long, n long, id long, " + LISTS


class Segment:
    """The lists of one segment, as they come in batches of LISTS."""

    def __init__(self):
        self.first, self.f, self.ids, self.lengths, self.places = [], [], [], [], []

    def add(self, b) -> None:
        lengths, ids = numbers_of(b.column("lengths")), numbers_of(b.column("ids"))
        # the number of lists of each row: one id ends where a byte below 128 stands
        data, at = column_bytes(b.column("ids"))
        lists = np.diff(np.concatenate([[0], np.cumsum(data < 128)])[at])
        self.ids.append(sums_of(ids, begins_of(lists), lists))
        self.first.append(np.repeat(b.column("first").to_numpy(), lists))
        self.f.append(np.repeat(b.column("f").to_numpy(), lists))
        self.lengths.append(lengths)
        self.places.append(sums_of(numbers_of(b.column("places")), begins_of(lengths), lengths))

    def met(self, segment: int, keep: bool, group: int) -> Iterator:
        """MET rows of the phrases that the lists make with each other."""
        import pyarrow as pa

        first, f, ids, lengths, places = (np.concatenate(x) for x in (self.first, self.f, self.ids, self.lengths, self.places))
        item = np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(places)
        at, item = places[order], item[order]
        here = np.flatnonzero(at[1:] == at[:-1] + 1)
        left, right, at = item[here], item[here + 1], at[here]
        if not len(left):
            return
        # the phrases of a common first word are dealt out by their last part
        parts = 1 + f[left] // group
        part = np.where(parts > 1, (mix64(ids[right].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
        order = np.lexsort((at, ids[right], ids[left], part, first[left]))
        left, right, at, part = left[order], right[order], at[order], part[order]
        new = lambda *columns: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        lists, rows = new(left, right, part), new(first[left], part)
        sizes = np.diff(np.append(lists, len(left)))
        steps = steps_of(at, lists)
        # rows as numbers of lists and of occurrences
        list_ends = np.append(np.searchsorted(lists, rows[1:]), len(lists))
        ends = np.append(rows[1:], len(left))
        row_begins = np.concatenate([[0], list_ends[:-1]])
        lefts = steps_of(ids[left[lists]], row_begins)
        for a in range(0, len(rows), ROWS):
            z = min(a + ROWS, len(rows))
            l0, l1, o0, o1 = int(row_begins[a]), int(list_ends[z - 1]), int(rows[a]), int(ends[z - 1])
            held = binary(steps[o0:o1], ends[a:z] - o0) if keep else pa.nulls(z - a, pa.binary())
            columns = [first[left[rows[a:z]]], part[rows[a:z]].astype(np.int32), np.full(z - a, segment), f[left[rows[a:z]]]]
            cut = list_ends[a:z] - l0
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binary(lefts[l0:l1], cut), binary(ids[right[lists[l0:l1]]], cut), binary(sizes[l0:l1], cut), held], names=["first", "part", "segment", "f", "left", "right", "lengths", "places"])


def runs_of(batches: Iterator, keys: list[str]) -> Iterator:
    """Slices of batches in which the keys are one; and the key."""
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True]]))
        for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            yield tuple(int(c[a]) for c in columns), b.slice(a, z - a)


def longer(lists: DataFrame, keep: bool) -> DataFrame:
    """MET of the phrases that one word more makes of lists (LISTS); places are null, unless kept."""
    parts, group = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), GROUP

    def run(batches: Iterator) -> Iterator:
        last, held = None, None
        for (segment,), b in runs_of(batches, ["segment"]):
            if segment != last:
                if held:
                    yield from held.met(last, keep, group)
                last, held = segment, Segment()
            held.add(b)
        if held:
            yield from held.met(last, keep, group)

    return lists.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(run, MET)


class Groups:
    """Phrases from all segments; a phrase of a first word and part has all its lists here."""

    def __init__(self, batches: list):
        self.batches = batches

    def counted(self, least: int, keep: bool, number) -> Iterator:
        """COUNTED rows; number gives so many new ids."""
        import pyarrow as pa

        b = pa.Table.from_batches(self.batches).combine_chunks().to_batches()[0]
        data, at = column_bytes(b.column("right"))
        lists = np.diff(np.concatenate([[0], np.cumsum(data < 128)])[at])
        left = sums_of(numbers_of(b.column("left")), begins_of(lists), lists)
        right, lengths = numbers_of(b.column("right")), numbers_of(b.column("lengths"))
        order = np.lexsort((right, left))
        new = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])])
        begins = np.flatnonzero(new)
        n = np.add.reduceat(lengths[order], begins)
        often = n >= least
        if not often.any():
            return
        k = int(often.sum())
        ids = np.full(len(begins), -1, np.int64)
        ids[often] = number(k)
        names = [x.split()[0].strip("`") for x in COUNTED.split(", ")]
        nothing = lambda n, *kinds: [pa.nulls(n, t) for t in kinds]
        whole, some = pa.int64(), pa.binary()
        found = [left[order][begins[often]], right[order][begins[often]], n[often], ids[often]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), *nothing(k, whole, whole, whole, some, some, some)], names=names)
        if not keep:
            return
        # each list's id; those of frequent phrases go back, row by row
        mine = np.empty(len(left), np.int64)
        mine[order] = ids[np.cumsum(new) - 1]
        stay, row = mine >= 0, np.repeat(np.arange(len(lists)), lists)
        steps = numbers_of(b.column("places"))[np.repeat(stay, lengths)]
        mine, row, lengths = mine[stay], row[stay], lengths[stay]
        ends = np.cumsum(lengths)
        # ids ascend within a row, as phrases do
        rows = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        list_ends = np.append(rows[1:], len(row))
        which = pa.array(row[rows])
        back = [b.column(c).take(which) for c in ("segment", "first", "f")]
        yield pa.RecordBatch.from_arrays([*nothing(len(rows), whole, whole, whole, whole), *back, binary(steps_of(mine, rows), list_ends), binary(lengths, list_ends), binary(steps, ends[list_ends - 1])], names=names)


def counted(met: DataFrame, least: int, keep: bool) -> DataFrame:
    """COUNTED of all MET rows; ids are numbers of their own for every phrase."""
    parts, together = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), TOGETHER

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        own, made = TaskContext.get().partitionId(), 0

        def number(k: int) -> np.ndarray:
            nonlocal made
            made += k
            return (np.arange(made - k, made, dtype=np.int64)) * parts + own

        held, lists = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            first, part = b.column("first").to_numpy(), b.column("part").to_numpy()
            if lists >= together:
                # the words before the last one are complete, here or with the last batch
                new = np.flatnonzero((first[1:] != first[:-1]) | (part[1:] != part[:-1])) + 1
                before = held[-1]
                cut = 0 if (before.column("first")[-1].as_py(), before.column("part")[-1].as_py()) != (int(first[0]), int(part[0])) else int(new[0]) if len(new) else None
                if cut is not None:
                    yield from Groups([*held, b.slice(0, cut)]).counted(least, keep, number)
                    b, held, lists = b.slice(cut), [], 0
            held.append(b)
            lists += b.num_rows
        if held:
            yield from Groups(held).counted(least, keep, number)

    return met.repartition(parts, "first", "part").sortWithinPartitions("first", "part").mapInArrow(run, COUNTED)


def one_list(places_ids: DataFrame) -> DataFrame:
    """LISTS rows of single words: segment, id, f, n, places."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            each = np.arange(1, b.num_rows + 1)
            ids, n = b.column("id"), b.column("n")
            yield pa.RecordBatch.from_arrays([b.column("segment"), ids, b.column("f"), binary(ids.to_numpy(), each), binary(n.to_numpy(), each), b.column("places")], names=["segment", "first", "f", "ids", "lengths", "places"])

    return places_ids.select("segment", "id", "f", "n", "places").mapInArrow(run, LISTS)


def levels(docs: DataFrame, longest: int, least: int, work: Work, segment_words: int = SEGMENT_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 on: lang, words, id, left, right, f, heads and tails of the phrases that occur least times;
    and all word occurrences n of each lang.

    heads, tails: the frequencies of the first (last) 1, 2, ... words, without the whole phrase.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first: a segment's number must stand for the same documents wherever it is read
    lists = work.table(word_lists(rows, segment_words), "lists")
    counts = work.table(lists.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    work.tidy()
    sizes = work.table(counts.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    none, mark = F.array().cast("array<long>"), F.monotonically_increasing_id()
    # small numbers: the place in the partition first
    number = mark.bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright(mark, 33)
    often = counts.where(F.col("f") >= least).repartition(parts, "lang", "word")
    found = work.table(often.select("lang", F.array("word").alias("words"), number.alias("id"), F.lit(-1).cast("long").alias("left"), F.lit(-1).cast("long").alias("right"), "f", none.alias("heads"), none.alias("tails")), "found-1")
    kept = work.table(one_list(lists.join(found.select("lang", F.col("words")[0].alias("word"), "id", "f").hint("merge"), ["lang", "word"])), "counted-1")
    work.drop("lists")
    work.tidy()
    out = [found]
    for m in range(2, longest + 1):
        keep = m < longest
        met = work.table(longer(kept, keep), f"met-{m}")
        work.drop(f"counted-{m - 1}")
        work.tidy()
        both = work.table(counted(met, least, keep), f"counted-{m}")
        work.drop(f"met-{m}")
        work.tidy()
        a, b = (found.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "words", "f", "heads", "tails")]).hint("merge") for side in ("left", "right"))
        named = both.where("id is not null").select("left", "right", "id", F.col("n").alias("f")).join(a, "left").join(b, "right")
        named = named.select(F.col("left_lang").alias("lang"), F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"), "id", "left", "right", "f", F.concat("left_heads", F.array("left_f")).alias("heads"), F.concat("right_tails", F.array("right_f")).alias("tails"))
        found = work.table(named, f"found-{m}")
        out.append(found)
        kept = both.where("segment is not null").select("segment", "first", "f", "ids", "lengths", "places")
    work.drop("counts", f"counted-{longest}")
    work.tidy()
    return out, sizes


def with_scores(phrases: DataFrame, length: int) -> DataFrame:
    """lang, words, id, a, l, r and score of the lowest-scoring cut of phrases of so many words."""
    exact = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, length):
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]  # noqa: E741
        phrases = phrases.withColumn(f"__ls_top{k}", F.lit(1_000_000).cast("decimal(38,0)") * exact(F.col("f")) * exact(F.col("f"))).withColumn(f"__ls_below{k}", exact(l) * exact(r))
        cuts.append(F.struct(F.expr(f"__ls_top{k} div __ls_below{k}").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return phrases.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "words", "id", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best top phrases of 2 to longest words of each lang of docs (lang, text).

    A phrase goes if a longer frequent one that holds it occurs at least share times for a hundred of its own.
    """
    work = Work(docs.sparkSession, "collocations")
    found, sizes = levels(docs, longest, least, work, segment_words)
    every = None
    for m in range(2, longest + 1):
        scored = with_scores(found[m - 1], m)
        if m < longest:
            # frequencies fall with length, so the phrases of one word more decide for all longer ones
            inside = found[m].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            scored = scored.join(inside.hint("merge"), "id", "left").where(F.expr(f"most IS NULL OR 100 * cast(most AS decimal(38,0)) < {int(share)} * cast(a AS decimal(38,0))"))
        scored = scored.select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "a", "l", "r", "score")
        every = scored if every is None else every.unionByName(scored)
    every = work.table(every, "scored")
    # first within parts of a language, whose number makes both steps about as large
    parts = max(1, int((every.count() / top) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
