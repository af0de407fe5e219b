"""Containment join: which rows' texts contain a value (case-insensitive).

Used by F2/F3 for value sets too large to inline: an exact blocked equi-join.
Each value gets one *key*, a piece of it that any text holding the value must
also yield:

- a value with whole interior words (white space on both sides inside the
  value) is keyed by a phrase of up to ``PHRASE`` of them: in any text that
  contains the value those words stand between white space too and follow each
  other, so they are a phrase of the text's words (split on the same space);
- any other value is keyed by a gram of ``LONG`` characters, or of ``Q`` when
  it is shorter than that; the shortest ones by themselves (texts yield grams
  of that length). A value whose phrases are all common can take a gram too.

Among its possible keys a value takes the one that is rarest in the texts, as
counted in a sample of them, then the one that fewest values have, then the
longest. Texts yield only the key kinds some value uses (phrases: about one
per six characters; grams: one per character). Keys, texts and values are
named by 64-bit hashes, so no exploded row carries a copy of any. The
candidate pairs (text hash, value hash) are written to the shared checkpoint
folder and measured; then every row is tested against its candidates with
``contains`` in a left-semi join on the hash. So the texts are read twice, once
for keys and once for the test, beside the sample.

The value keys are broadcast when their number and bytes are within bounds,
so text keys meet them in the scan; beyond, the text keys are shuffled and
Spark drops most of them before that by a runtime Bloom filter. Candidates
within the broadcast bound are broadcast: the texts never leave their scan
tasks. Beyond it both sides are shuffled on the hash, so each text moves once.
A hash collision only adds candidates; the ``contains`` test is exact. No pair
is lost, no cap is set; work grows with text length, not texts x values. The
sample steers the amount of work, never which pairs come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import written

Q, LONG, PHRASE = 4, 8, 3
# Bounds for broadcasting the value side (values, their keys, key counts).
MAX_BROADCAST_KEYS = 1_000_000
MAX_BROADCAST_BYTES = 16 << 20
# The sample of texts for key frequencies: rows of so many files, evenly spread
# over the list of them, and of these one text in so many (by hash).
SAMPLE_FILES, SAMPLE_ONE_IN = 16, 8
# A phrase is common when it stands more than once in this many sampled texts.
RARE_TEXTS = 100
# The white space between words (Java regex \s: space, tab,
# newline, vertical tab, form feed, carriage return).
WORD_SPLIT = r"\s+"
# Key kinds: phrases of 1 to PHRASE words by that number, grams by GRAM plus their length.
GRAM = 10


def _grams(text: Column, length: int) -> Column:
    """Runs of ``length`` consecutive characters of a text column.

    One pass of a JVM regex with a capturing lookahead (overlapping
    matches), linear in the text length and kept out of Python. Not
    de-duplicated per text (it cost as much as the regex): repeats weigh the
    frequencies and are removed after the join."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), 1)


def _gram_keys(text: Column, length: int) -> Column:
    return F.transform(_grams(text, length), lambda g: F.xxhash64(F.lit(GRAM + length), g))


def _phrase_keys(words: Column, m: int) -> Column:
    """Hashes of the phrases of ``m`` consecutive words of an array."""
    if m == 1:
        return F.transform(words, lambda w: F.xxhash64(F.lit(1), w))

    def phrase(i):
        return F.xxhash64(F.lit(m), *[F.get(words, i + k) for k in range(m)])

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= m, F.transform(F.sequence(F.lit(0), F.size(words) - m), phrase)).otherwise(none)


class KeyPlan:
    """The keys that the values could have, and which one each takes.

    Built by one small job over the values, which also gives their count and
    total length (``n_values``, ``chars``) for callers choosing a strategy."""

    def __init__(self, values: DataFrame, value_col: str):
        self.value_col = value_col
        parts = F.split(F.col("_low_v"), WORD_SPLIT)
        inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
        vl = (values.select(F.col(value_col), F.lower(F.col(value_col)).alias("_low_v"))
              .withColumn("_len_v", F.length("_low_v")).withColumn("_words", inner))
        m = F.least(F.size("_words"), F.lit(PHRASE))
        gram = F.when(F.col("_len_v") >= LONG, LONG).otherwise(F.least(F.col("_len_v"), F.lit(Q)))
        # the phrase length of a value (0: none), and its gram length (0: not wanted)
        self.vl = vl.withColumn("_m", m).withColumn("_g", F.when(m < PHRASE, gram).otherwise(0))
        keys = F.greatest(F.size("_words"), F.lit(1)) + F.when(F.col("_g") > 0, F.col("_len_v")).otherwise(0)
        # One small job over the values: how many, how long, which key kinds.
        stats = self.vl.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("_len_v"), F.lit(0)).alias("chars"),
            F.collect_set("_m").alias("phrases"), F.collect_set("_g").alias("grams"),
            F.coalesce(F.sum(keys), F.lit(0)).alias("keys"),
            F.coalesce(F.sum((F.col("_len_v") == 0).cast("int")), F.lit(0)).alias("blank"),
        ).first()
        self.n_values = int(stats["n"])
        self.chars = int(stats["chars"])
        self.kinds = sorted({int(x) for x in stats["phrases"] if x} | {GRAM + int(x) for x in stats["grams"] if x})
        # The value side is broadcast only within a measured bound; otherwise
        # the joins below are sort-merge joins (the text side is never a
        # build side: it grows with the texts).
        # Each value has one key in the join, but its possible keys are weighed
        # before: both their number and the bytes of one key per value count.
        self.has_empty = stats["blank"] > 0
        self.small = stats["keys"] <= MAX_BROADCAST_KEYS and \
            4 * stats["chars"] + 64 * stats["n"] <= MAX_BROADCAST_BYTES

    @property
    def empty(self) -> bool:
        return not self.kinds

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df.hint("merge")

    def options(self) -> DataFrame:
        """(_vid, _kind, _key, _size): every key a value could take."""
        vl = self.vl.withColumn("_vid", F.xxhash64(self.value_col))
        none = F.array().cast("array<bigint>")
        made = None
        for kind in self.kinds:
            keys = _phrase_keys(F.col("_words"), kind) if kind <= PHRASE else _gram_keys(F.col("_low_v"), kind - GRAM)
            wanted = F.col("_m" if kind <= PHRASE else "_g") == (kind if kind <= PHRASE else kind - GRAM)
            one = vl.select("_vid", F.lit(kind).alias("_kind"), F.explode(F.when(wanted, keys).otherwise(none)).alias("_key"))
            made = one if made is None else made.unionByName(one)
        return made.distinct()

    def keyed(self, df: DataFrame, text: Column) -> DataFrame:
        """(_vid, _kind, _key): each value, by its hash, with the key it takes; written."""
        opts = written(self.options(), "value-options")
        sample = explode_keys(sample_texts(df, text), F.lower(text), self.kinds, F.xxhash64(text).alias("_tid"))
        seen = (sample.join(self.side(opts.select("_key").distinct()), "_key").groupBy("_key")
                .agg(F.count(F.lit(1)).alias("_seen")))
        shared = opts.groupBy("_key").agg(F.count(F.lit(1)).alias("_shared"))
        n = sample_texts(df, text).count()
        seen_n = F.coalesce("_seen", F.lit(0))
        plain = (F.col("_kind") <= PHRASE) & (seen_n * RARE_TEXTS <= n)
        rank = F.struct(F.when(plain, 0).otherwise(1).alias("c"), seen_n.alias("s"), "_shared", (-F.col("_kind")).alias("k"), "_key")
        best = (opts.join(shared, "_key").join(seen, "_key", "left").groupBy("_vid")
                .agg(F.min_by(F.struct("_kind", "_key"), rank).alias("_k")))
        return written(best.select("_vid", "_k._kind", "_k._key"), "value-keys")


def sample_texts(df: DataFrame, text: Column) -> DataFrame:
    """The sampled rows with a text."""
    files = sorted(df.inputFiles())
    if len(files) > SAMPLE_FILES:
        step = len(files) / SAMPLE_FILES
        some = [files[int(k * step)] for k in range(SAMPLE_FILES)]
        some += [f.replace("file:///", "file:/", 1) for f in some]  # local paths are spelled in two ways
        try:
            part = df.where(F.col("_metadata.file_path").isin(some))
            part.schema  # noqa: B018 - resolves the hidden column now
            df = part
        except AnalysisException:  # no longer the rows of files
            pass
    return df.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(SAMPLE_ONE_IN)) == 0))


def explode_keys(df: DataFrame, low_t: Column, kinds: list[int], *keep: Column) -> DataFrame:
    """(*keep, _key) for every key of the wanted kinds that a text yields.

    Grams alone, one per character, are cut out in one pass (the longest at
    each place, the shorter ones are its beginnings) and hashed behind the
    explode, in generated code; with phrases among them arrays of hashes are
    put together."""
    if kinds and min(kinds) > PHRASE:
        lengths = [k - GRAM for k in kinds]
        each = df.select(*keep, low_t.alias("_rs_low"))
        names = each.columns[:len(keep)]
        pattern = f"(?s)(?=(.{{{min(lengths)},{max(lengths)}}}))"
        each = each.select(*names, F.explode(F.regexp_extract_all("_rs_low", F.lit(pattern), 1)).alias("_rs_gram"))
        keys = [F.when(F.length("_rs_gram") >= n, F.xxhash64(F.lit(GRAM + n), F.substring("_rs_gram", 1, n))) for n in lengths]
        if len(keys) == 1:
            return each.select(*names, keys[0].alias("_key"))
        return each.select(*names, F.explode(F.array(*keys)).alias("_key")).where(F.col("_key").isNotNull())
    arrays = [_phrase_keys(F.col("_rs_words"), k) if k <= PHRASE else _gram_keys(F.col("_rs_low"), k - GRAM) for k in kinds]
    rows = df.select(*keep, low_t.alias("_rs_low"))
    if any(k <= PHRASE for k in kinds):
        rows = rows.withColumn("_rs_words", F.split("_rs_low", WORD_SPLIT))
    names = rows.columns[:len(keep)]
    return rows.select(*names, F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("_key"))


def candidates(df: DataFrame, text: Column, values: DataFrame, value_col: str,
               plan: KeyPlan | None = None) -> DataFrame | None:
    """Distinct ``(_tid, _low_v)``, ``_tid = xxhash64(text)``: every text with
    a lower-cased value it may contain; the pairs of hashes are written to the
    shared folder (computed once). None when there are no values."""
    plan = plan or KeyPlan(values, value_col)
    if plan.empty:
        return None
    keyed = plan.keyed(df, text)
    used = sorted(r[0] for r in keyed.select("_kind").distinct().collect())  # a handful of kinds
    pairs = written(explode_keys(df.where(text.isNotNull()), F.lower(text), used, F.xxhash64(text).alias("_tid"))
                    .join(plan.side(keyed.select("_vid", "_key")), "_key", "inner")
                    .select("_tid", "_vid").distinct(), "candidates")
    named_values = plan.vl.select(F.xxhash64(value_col).alias("_vid"), "_low_v")
    return pairs.join(plan.side(named_values), "_vid").select("_tid", "_low_v")


def _measured(cand: DataFrame) -> DataFrame:
    """The candidate side, broadcast when measured within the bound (value
    bytes as stored, plus a per-row allowance for the hash and the row)."""
    size = cand.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.octet_length("_low_v")), F.lit(0)).alias("bytes")).first()
    small = size["bytes"] + 48 * size["n"] <= MAX_BROADCAST_BYTES
    return F.broadcast(cand) if small else cand.hint("merge")


def rows_containing(df: DataFrame, text: Column, values: DataFrame, value_col: str,
                    extra: Column | None = None, plan: KeyPlan | None = None) -> DataFrame:
    """Rows of ``df`` whose ``text`` contains at least one value (ignoring
    case), or for which ``extra`` is true. All columns kept, no duplicates.

    Without ``extra``: a left-semi join with the candidates. With it: one
    filter ``extra OR EXISTS (candidate of this row's hash contained in its
    text)``, which Spark plans as an ExistenceJoin, so ``df`` is still
    scanned once. No shuffle when the candidates are broadcast."""
    cand = candidates(df, text, values, value_col, plan)
    if cand is None:
        return df.where(F.lit(False)) if extra is None else df.where(extra)
    side = _measured(cand.select("_tid", "_low_v"))
    if extra is None:
        cond = (F.xxhash64(text) == side["_tid"]) & F.lower(text).contains(side["_low_v"])
        return df.join(side, cond, "left_semi")
    outer = text.outer()
    hit = side.where((side["_tid"] == F.xxhash64(outer))
                     & F.lower(outer).contains(side["_low_v"])).exists()
    return df.where(F.coalesce(extra, F.lit(False)) | hit)
