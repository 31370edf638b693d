"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings
of that text. A document is parsed greedily into the longest phrases the automaton
accepts (a character it does not know is a phrase); the phrases needed, times the bits
to name a place in the reference, over the characters, estimate the cross-entropy. The
language with the smallest estimate wins; equal estimates go to the first name.

Texts are read whole: letters in lower case, every run of other characters as one space.
They are cut into segments that are parsed side by side, one array step a character, so
the cost per character does not depend on the text's length.

The reference is a bounded sample: ``PIECES`` pieces of ``PIECE_CHARS`` characters for
each language, chosen by a hash of the document id among the rows with a label that are
not held out. Every label and every letter of the references is learned; automata whose
tables would be large keep their transitions sorted instead, with the same results. References are a table
with a row for each label: ``BLOCK`` labels at a time are broadcast, further ones take further passes, so
neither the driver nor a worker holds more than a block however many labels there are.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where
nothing was learned; a null id is never held out; repeated rows get equal results. A kept
column with a result's name gives way to it; ``recognised`` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import draw
from .storage import Shared, slices, written

PIECES, PIECE_CHARS = 120, 400
#: Bytes of transition tables in a worker; automata beyond search sorted transitions.
TABLES = 1 << 29
#: Characters parsed side by side, and the length of a segment.
CHUNK, SEGMENT = 1 << 21, 512
#: A reference of fewer letters and spaces says nothing about what is not in it.
LEAST = 2000
#: Labels whose automata a pass holds.
BLOCK = 64
#: Lengths the limits are fitted for, parts of a reference held out in turn, and the shares of own texts above and of others' below a limit's two
#: bounds; references hold passages of other languages, so the bounds leave room for some.
LENGTHS, FOLDS, OWN, FOREIGN = (12, 25, 50, 100, 200, 400), 4, 0.95, 0.05
#: Where between the two bounds a limit lies: nearer to the own texts, as a language nobody labelled may be closer than those that are.
BETWEEN = 0.48
#: Pieces of all references that stand for foreign text when limits are fitted: a bounded sample, as the references are.
POOL = 2000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(lang, text): labelled text for each language, at most ``pieces * (piece_chars + 1)`` characters."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * pieces / F.count("*")).alias("share"))
    # labels are counted by a pass of their own; a language whose rows fill a third of the table is thinned before any of it is shuffled
    some = rows.withColumn("u", draw(F.col("id"), 9)).join(written(share, "shares"), "lang").filter("u < share")
    start = 1 + F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - piece_chars, F.lit(1)))
    some = some.select("lang", "u", F.substring("text", start.cast("int"), F.lit(piece_chars)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "piece"))
    kept = some.withColumn("k", rank).filter(F.col("k") <= pieces).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"))
    return written(kept.select("lang", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("text")), "references")


def _blocks(learned: DataFrame, block: int) -> list[list[str]]:
    """Names of the labels, by blocks; names alone are on the driver."""
    names = sorted(r["lang"] for r in learned.select("lang").collect())
    return [names[i : i + block] for i in range(0, len(names), block)]


def _texts(learned: DataFrame, names: list[str]) -> dict[str, str]:
    return {r["lang"]: r["text"] for r in learned.filter(F.col("lang").between(names[0], names[-1])).collect()}


class Alphabet:
    """Classes of code points: 0 for all that is no letter, then the references' letters, then any other letter."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(letters) + 2
        place = {c: i + 1 for i, c in enumerate(letters)}
        self.kind = np.uint8 if self.size <= 256 else np.int32
        self.of = np.fromiter((place.get(c.lower(), self.size - 1) if c.isalpha() else 0 for c in map(chr, range(0x110000))), self.kind, 0x110000)

    def classes(self, text: str) -> np.ndarray:
        x = self.of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return x[(x != 0) | (np.concatenate([[1], x[:-1]]) != 0)] if len(x) else x


class Dense:
    """Transitions by a flat table (state * size + class); -1 where there is none. ``dead`` has none at all."""

    def __init__(self, nxt: list[dict[int, int]], size: int):
        self.dead = len(nxt) * size
        self.table = np.full(self.dead + size, -1, np.int32)
        for s, row in enumerate(nxt):
            for c, t in row.items():
                self.table[s * size + c] = t * size

    def step(self, state: np.ndarray | int, c: np.ndarray) -> np.ndarray:
        return self.table[state + c]


class Sparse:
    """The same, by search among the transitions that there are."""

    def __init__(self, nxt: list[dict[int, int]], size: int):
        self.dead = len(nxt) * size
        self.keys = np.array([s * size + c for s, row in enumerate(nxt) for c in sorted(row)] or [-1], np.int64)
        self.to = np.array([row[c] * size for row in nxt for c in sorted(row)] or [-1], np.int64)

    def step(self, state: np.ndarray | int, c: np.ndarray) -> np.ndarray:
        key = state + c.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def automaton(x: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of x."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in x.tolist():
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = twin
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    return nxt


class Parser:
    def __init__(self, texts: dict[str, str]):
        self.alphabet = Alphabet(list(texts.values()))
        self.names = sorted(texts)
        refs = [self.alphabet.classes(texts[n]) for n in self.names]
        self.tables, held = [], 0
        for x in refs:
            nxt = automaton(x)
            cells = (len(nxt) + 1) * self.alphabet.size
            dense = held + 4 * cells <= TABLES and cells < 1 << 31
            held += 4 * cells if dense else 0
            self.tables.append((Dense if dense else Sparse)(nxt, self.alphabet.size))
        self.bits = np.array([np.log2(max(2, len(r))) for r in refs])

    def _phrases(self, table: Dense | Sparse, columns: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Phrases of each segment. columns: classes, a row for each place; live: segments at each place, longest first."""
        count = np.ones(columns.shape[1], np.int64)
        first = table.step(0, np.arange(self.alphabet.size))
        # a character the language does not have is a phrase, and so is what follows
        first = np.where(first < 0, table.dead, first)
        state = first[columns[0]]
        for place in range(1, len(columns)):
            c = columns[place, : live[place]]
            now = table.step(state[: live[place]], c)
            ends = now < 0
            count[: live[place]] += ends
            state[: live[place]] = np.where(ends, first[c], now)
        return count

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters seen?, bits a character): a row for each text, a column for each language."""
        return self.measured(texts)[:2]

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``entropies``, and the characters that count of each text."""
        bits, seen, lengths_of = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held < CHUNK):
                held += len(texts[end] or "")
                end += 1
            codes = [self.alphabet.classes(t or "") for t in texts[at:end]]
            seen[at:end] = [bool(c.any()) for c in codes]
            parts = [(k, c[i : i + SEGMENT]) for k, c in enumerate(codes) if seen[at + k] for i in range(0, len(c), SEGMENT)]
            for low in range(0, len(parts), CHUNK // SEGMENT):
                some = sorted(parts[low : low + CHUNK // SEGMENT], key=lambda p: -len(p[1]))
                lengths = np.array([len(p[1]) for p in some])
                columns = np.zeros((lengths[0], len(some)), self.alphabet.kind)
                for j, (_, c) in enumerate(some):
                    columns[: len(c), j] = c
                live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
                owner = np.array([p[0] for p in some])
                for k, table in enumerate(self.tables):
                    np.add.at(bits[at:end, k], owner, self._phrases(table, columns, live) * self.bits[k])
            lengths_of[at:end] = [len(c) for c in codes]
            bits[at:end] /= np.maximum(lengths_of[at:end], 1)[:, None]
            at = end
        return seen, bits, lengths_of


_parsers: dict[int, Parser] = {}


def _parser(shared: Shared) -> Parser:
    if shared.id not in _parsers:
        _parsers.clear()
        _parsers[shared.id] = Parser(shared.value)
    return _parsers[shared.id]


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn("_place", F.monotonically_increasing_id()), "numbered")


def _ranked(rows: DataFrame, shared: Shared, n: int, fields: list) -> DataFrame:
    """The first ``n`` columns of ``rows``, whose next one is the text, with the block's two best languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared)
        for batch in slices(batches, 1024):
            seen, bits = parser.entropies(batch.column(n).to_pylist())
            order = np.argsort(bits, axis=1, kind="stable")[:, :2]
            best = [[{"bits": float(bits[i, k]), "lang": parser.names[k]} for k in order[i]] if s else [] for i, s in enumerate(seen)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(best, pa.list_(pa.struct([("bits", pa.float64()), ("lang", pa.string())])))], [*batch.schema.names[:n], "_best"])

    best = T._parse_datatype_string("_best array<struct<bits:double,lang:string>>").fields
    return rows.mapInArrow(run, T.StructType([*fields, *best]))


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``keep`` columns (all by default) with lang_pred, score (how far the runner-up lies behind, 0 to 1) and bits a character.

    ``learned``: the ``references``.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "bits")]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    fields = [docs.schema[c] for c in keep]
    blocks = _blocks(learned, block)
    if not blocks:
        return source.drop("_text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits": F.lit(None).cast("double")})
    if len(blocks) == 1:
        ranked = _ranked(source, Shared(docs.sparkSession, _texts(learned, blocks[0])), len(keep), fields)
    else:
        numbered = _numbered(source)
        found = None
        for names in blocks:
            shared = Shared(docs.sparkSession, _texts(learned, names))
            # written, so that a block's broadcast is released before the next
            part = written(_ranked(numbered.select("_place", "_text"), shared, 1, [T.StructField("_place", T.LongType())]), "block")
            shared.broadcast.unpersist()
            found = part if found is None else found.unionByName(part)
        best = found.groupBy("_place").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, 2).alias("_best"))
        ranked = numbered.drop("_text").join(best, "_place").drop("_place")
    alone = sum(map(len, blocks)) == 1
    first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    seen = F.size("_best") > 0
    behind = F.lit(1.0) if alone else 1 - first["bits"] / F.greatest(second["bits"], F.lit(1e-12))
    score = F.when(seen, F.greatest(F.lit(0.0), F.least(F.lit(1.0), behind))).otherwise(0.0)
    return ranked.select(*keep, F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), score.alias("score"), first["bits"].alias("bits"))


def _probes(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(0, len(text) - n + 1, max(n, len(text) // 400))]


def fit(name: str, text: str, foreign: list[tuple[str, str]]) -> list[float]:
    """The most bits a character that a text of each of ``LENGTHS`` may cost in a language.

    Parts of the language's reference are parsed by the rest of it, which gives the bits of its own texts; ``foreign``
    (language, piece) those of texts in other languages. The limit lies between what all but a few
    own texts stay under and what all but a few foreign ones exceed, whichever is more. With no other language, the
    text read backwards (the same letters in none) stands for one.
    """
    step = -(-len(text) // FOLDS)
    own: dict[int, list[float]] = {n: [] for n in LENGTHS}
    other: dict[int, list[float]] = {n: [] for n in LENGTHS}
    others = [piece for lang, piece in foreign if lang != name]
    for fold, at in enumerate(range(0, len(text), step)):
        parser = Parser({name: f"{text[:at]} {text[at + step:]}"})
        part = text[at : at + step]
        away = others[fold::FOLDS] if others else [part[::-1]]
        for n in LENGTHS:
            for sink, probes in ((own, _probes(part, n)), (other, [p for piece in away for p in _probes(piece, n)])):
                seen, bits = parser.entropies(probes)
                sink[n] += bits[seen, 0].tolist()
    most = [float(np.quantile(own[n], OWN)) if own[n] else np.inf for n in LENGTHS]
    least = [float(np.quantile(other[n], FOREIGN)) if other[n] else m for n, m in zip(LENGTHS, most, strict=True)]
    return [a + BETWEEN * (b - a) for a, b in zip(most, least, strict=True)]


def limits(learned: DataFrame, pool: int = POOL) -> DataFrame:
    """(lang, limits) of the languages with ``LEAST`` characters of reference, each fitted in a task of its own.

    The foreign text is a bounded sample of the references' pieces; languages with less reference have no limit.
    """
    spark = learned.sparkSession
    usable = learned.filter(F.length("text") >= LEAST)
    pieces = usable.select("lang", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(PIECE_CHARS + 1))).alias("at"), "text").select("lang", "at", F.substring("text", F.col("at"), F.lit(PIECE_CHARS)).alias("piece"))
    some = [(r["lang"], r["piece"]) for r in pieces.orderBy(F.md5(F.concat_ws(":", "lang", F.col("at").cast("string")))).limit(pool).collect()]
    shared = Shared(spark, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [fit(name, text, shared.value) for name, text in zip(names, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["lang", "limits"])

    labels = usable.count()
    return written(usable.repartition(max(1, min(labels, 200)), "lang").mapInArrow(run, "lang string, limits array<double>"), "limits")


def _limit(limit: list[float], n: np.ndarray) -> np.ndarray:
    """A shorter text than the first length may cost as much in all."""
    return np.interp(np.log(np.maximum(n, 1)), np.log(LENGTHS), limit) * np.maximum(1, LENGTHS[0] / np.maximum(n, 1))


def _accepted(rows: DataFrame, shared: Shared, at: int, most: dict[str, list[float]] | float) -> DataFrame:
    """The rows whose text, in column ``at``, has a letter and stays under the limit in one language of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared)
        for batch in slices(batches, 1024):
            seen, bits, n = parser.measured(batch.column(at).to_pylist())
            limit = np.stack([_limit(most[k], n) for k in parser.names], axis=1) if isinstance(most, dict) else most
            yield batch.filter(pa.array(seen & (bits <= limit).any(axis=1)))

    return rows.mapInArrow(run, rows.schema)


def recognised(docs: DataFrame, learned: DataFrame, max_bits: float | DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, as they are, whose text has a letter and costs ``max_bits`` a character at most in one language.

    ``max_bits`` is one number, or the ``limits`` by language and length; languages without
    limits recognise nothing then, and where none has limits, every text with a letter stays.
    """
    spark = docs.sparkSession
    if isinstance(max_bits, DataFrame):
        if learned.isEmpty():
            return docs.limit(0)
        if max_bits.isEmpty():
            return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
        learned = learned.join(max_bits.select("lang"), "lang", "left_semi")
    blocks = _blocks(learned, block)
    if not blocks:
        return docs.limit(0)

    def most(names: list[str]) -> dict[str, list[float]] | float:
        return {r["lang"]: list(r["limits"]) for r in max_bits.filter(F.col("lang").between(names[0], names[-1])).collect()} if isinstance(max_bits, DataFrame) else max_bits

    at = docs.columns.index(text)
    if len(blocks) == 1:
        return _accepted(docs, Shared(spark, _texts(learned, blocks[0])), at, most(blocks[0]))
    places = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = _numbered(docs.toDF(*places))
    kept = None
    for names in blocks:
        shared = Shared(spark, _texts(learned, names))
        part = written(_accepted(numbered.select("_place", places[at]), shared, 1, most(names)).select("_place"), "block")
        shared.broadcast.unpersist()
        kept = part if kept is None else kept.unionByName(part)
    return numbered.join(kept.distinct(), "_place", "left_semi").drop("_place").toDF(*docs.columns)
