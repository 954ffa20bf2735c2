"""Error analysis of transcripts: edit distances, alignments and the reports on them.

Character distances are a built-in function. Word distances and alignments have none for arrays; they run in Arrow batches
over (reference, hypothesis) pairs, and everything after them is relational."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from corpusloom.functions import text as T

OPS = D.ArrayType(D.StructType([D.StructField("pos", D.IntegerType()), *(D.StructField(k, D.StringType()) for k in ("op", "ref", "hyp"))]))
RUNS = D.ArrayType(D.StructType([D.StructField(k, D.StringType()) for k in ("before", "after")]))


def _coded(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray]:
    codes: dict = {}
    return tuple(np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (ref, hyp))


def _next_row(row: np.ndarray, item: int, hyp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The costs of one more reference item; insertions run along the row as a running minimum."""
    new = row + 1
    new[1:] = np.minimum(new[1:], row[:-1] + (hyp != item))
    return np.minimum.accumulate(new - places) + places


def distance(ref: list, hyp: list) -> int:
    """Edit distance by bit vectors: one integer holds the steps of a whole column of costs."""
    m = len(ref)
    if not m:
        return len(hyp)
    where: dict = {}
    for i, x in enumerate(ref):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for y in hyp:
        eq = where.get(y, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (~(h | up) & full), up & h
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (~(v | more) & full), more & v
    return score


def alignment(ref: list, hyp: list) -> list[dict]:
    """Operations in order; going back from the end a match or substitution comes before a deletion, that before an insertion.

    Only every so many rows of costs are kept, and those between two of them are made again on the way back, so long texts
    take the root of the table's memory."""
    if len(ref) == len(hyp):
        # if no shift pays off, the way back stays on the diagonal, whose steps come first
        wrong = sum(x != y for x, y in zip(ref, hyp, strict=True))
        if wrong <= 1 or wrong == distance(ref, hyp):
            return [{"pos": k, "op": "ok" if x == y else "sub", "ref": x, "hyp": y} for k, (x, y) in enumerate(zip(ref, hyp, strict=True))]
    a, b = _coded(ref, hyp)
    places = np.arange(len(b) + 1)
    block = max(1, int(len(a) ** 0.5))
    kept, row = [places], places
    for k, item in enumerate(a):
        row = _next_row(row, item, b, places)
        if (k + 1) % block == 0:
            kept.append(row)
    i, j, out, first, table = len(a), len(b), [], len(a) + 1, []
    while i or j:
        if i and i - 1 < first:  # rows first..i of the table are needed
            first = (i - 1) // block * block
            table = [kept[first // block]]
            for item in a[first:i]:
                table.append(_next_row(table[-1], item, b, places))
        differ = bool(i and j) and bool(a[i - 1] != b[j - 1])
        if i and j and table[i - first][j] == table[i - 1 - first][j - 1] + differ:
            i, j = i - 1, j - 1
            out.append(("sub" if differ else "ok", ref[i], hyp[j]))
        elif i and table[i - first][j] == table[i - 1 - first][j] + 1:
            i -= 1
            out.append(("del", ref[i], None))
        else:
            j -= 1
            out.append(("ins", None, hyp[j]))
    return [{"pos": k, "op": o, "ref": r, "hyp": h} for k, (o, r, h) in enumerate(reversed(out))]


class Pairs:
    """The pairs of an Arrow batch as codes in two flat arrays.

    A pair of equal lengths is sure if its distance is the number of places that differ: it is, if one place differs at most,
    or if the items at these places have none in common, as each must then be replaced. All pairs are tested at once."""

    def __init__(self, ref: pa.Array, hyp: pa.Array):
        self.valid = pc.and_(ref.is_valid(), hyp.is_valid()).to_numpy(zero_copy_only=False)
        self.flat, self.lengths, self.codes = (self._letters if pa.types.is_string(ref.type) else self._items)(ref, hyp)
        self.starts = [np.cumsum(n) - n for n in self.lengths]
        self.wrong, self.sure = self._diagonal()

    @staticmethod
    def _items(ref, hyp):
        flat, lengths = [pc.list_flatten(x) for x in (ref, hyp)], [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp)]
        codes = pc.fill_null(pc.dictionary_encode(pa.concat_arrays(flat)).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return flat, lengths, [codes[: len(flat[0])], codes[len(flat[0]) :]]

    @staticmethod
    def _letters(ref, hyp):
        flat = [np.frombuffer("".join(x for x in side.to_pylist() if x is not None).encode("utf-32-le", "surrogatepass"), "<u4") for side in (ref, hyp)]
        return flat, [pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp)], [x.astype(np.int64) for x in flat]

    def _diagonal(self):
        (la, lb), (a, b), rows = self.lengths, self.codes, len(self.valid)
        same = la == lb
        a, b, row = a[np.repeat(same, la)], b[np.repeat(same, lb)], np.repeat(np.arange(rows)[same], la[same])
        off = a != b
        a, b, row = a[off], b[off], row[off]
        wrong, base = np.bincount(row, minlength=rows), max(a.max(initial=0), b.max(initial=0)) + 1
        keys, at = np.unique(np.concatenate([row * base + a, row * base + b]), return_inverse=True)
        net = np.abs(np.bincount(at, np.repeat([1.0, -1.0], len(row)), len(keys)))
        apart = np.bincount(keys // base, net, rows)  # items without a partner, those of both sides
        return wrong, same & self.valid & ((wrong <= 1) | (apart == 2 * wrong))

    def both(self, i: int) -> list[list]:
        return [c[s[i] : s[i] + n[i]].tolist() for c, s, n in zip(self.codes, self.starts, self.lengths, strict=True)]

    def distances(self, most_cells: int = 0) -> pa.Array:
        """Distances; null for nulls, and for pairs that are not sure and have no more than most_cells cells."""
        out, known = self.wrong.astype(np.int32), self.valid.copy()
        for i in np.flatnonzero(self.valid & ~self.sure):
            known[i] = self.lengths[0][i] * self.lengths[1][i] > most_cells or not most_cells
            out[i] = distance(*self.both(i)) if known[i] else 0
        return pa.array(out, pa.int32(), mask=~known)

    def steps(self):
        """(number of steps for each pair, their operations as places in STEPS, places of their items in flat or -1)."""
        found = {i: [STEPS.index(o["op"]) for o in alignment(*self.both(i))] for i in np.flatnonzero(self.valid & ~self.sure)}
        n = np.where(self.sure, self.lengths[0], 0)
        for i, ops in found.items():
            n[i] = len(ops)
        first, sure = np.cumsum(n) - n, np.repeat(self.sure, n)
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        at = [inside + np.repeat(s, n) for s in self.starts]
        op = np.zeros(len(inside), np.int64)
        op[sure] = self.codes[0][at[0][sure]] != self.codes[1][at[1][sure]]
        for i, ops in found.items():
            here, ops = slice(first[i], first[i] + n[i]), np.array(ops, np.int64)
            op[here] = ops
            for k, missing in enumerate((INSERTED, DELETED)):
                there = ops != missing
                at[k][here] = np.where(there, self.starts[k][i] + np.cumsum(there) - 1, -1)
        return n, inside, op, at


STEPS = ("ok", "sub", "del", "ins")
DELETED, INSERTED = 2, 3


@F.arrow_udf(D.IntegerType())
def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return Pairs(ref, hyp).distances()


#: Cells up to which a distance of letters that is not sure is left to the built-in function.
MOST_CELLS = 1 << 14


@F.arrow_udf(D.IntegerType())
def _long_or_sure(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return Pairs(ref, hyp).distances(MOST_CELLS)


def letter_distance(ref: Column, hyp: Column) -> Column:
    return F.coalesce(_long_or_sure(ref, hyp), F.levenshtein(ref, hyp))


@F.arrow_udf(OPS)
def align(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The operations of each pair of lists; none if one is null."""
    pairs = Pairs(ref, hyp)
    n, pos, op, at = pairs.steps()
    sides = [flat.take(pa.array(i, mask=i < 0)) for flat, i in zip(pairs.flat, at, strict=True)]
    out = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(STEPS).take(pa.array(op)), *sides], ["pos", "op", "ref", "hyp"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), out)


def joined_letters(c) -> Column:
    return F.array_join(T.scoring_words(c), "")


def with_cer(rows: DataFrame) -> DataFrame:
    """rows (text, hyp, ...) with cer."""
    both = rows.withColumn("_r", joined_letters("text")).withColumn("_h", joined_letters("hyp"))
    return both.withColumn("cer", letter_distance(F.col("_r"), F.col("_h")) / F.greatest(F.char_length("_r"), F.lit(1))).drop("_r", "_h")


def scored(rows: DataFrame) -> DataFrame:
    """rows (text, hyp, ...) with words, wrong words, letters and wrong letters."""
    ref = T.scoring_words("text")
    out = rows.withColumn("_r", ref).withColumn("_h", T.scoring_words("hyp"))
    out = out.withColumn("words", F.size("_r")).withColumn("wrong", word_distance("_r", "_h"))
    out = out.withColumn("_a", F.array_join("_r", "")).withColumn("_b", F.array_join("_h", ""))
    out = out.withColumn("letters", F.char_length("_a")).withColumn("wrong_letters", letter_distance(F.col("_a"), F.col("_b")))
    return out.withColumn("broken", (F.size("_h") == 0) | (F.col("wrong") / F.greatest("words", F.lit(1)) > 0.5)).drop("_r", "_h", "_a", "_b")


def corpus_score(rows: DataFrame, *by: str) -> DataFrame:
    """Clips, micro-averaged WER and CER, broken clips; rows as scored() gives them."""
    rate = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("clips"), rate("wrong", "words").alias("wer"), rate("wrong_letters", "letters").alias("cer"), F.count_if("broken").alias("broken"))


def aligned(rows: DataFrame, *also: str) -> DataFrame:
    """rows (row_id, version, text, hyp) -> row_id, version and the operations of the alignment of words, as a list."""
    return rows.select("row_id", "version", *also, align(T.scoring_words("text"), T.scoring_words("hyp")).alias("ops"))


def operations(rows: DataFrame) -> DataFrame:
    """rows (row_id, version, text, hyp) -> one row for each operation of the alignment of words."""
    return aligned(rows).select("row_id", "version", F.explode("ops").alias("o")).select("row_id", "version", "o.*")


def letter_operations(rows: DataFrame) -> DataFrame:
    """rows (version, text, hyp) -> version, op, ref, hyp, n: operations of the alignments of letters, with blanks between words.

    They are counted batch by batch, so that few rows leave a batch."""
    side = lambda c: F.array_join(T.scoring_words(c), " ")
    names = ["version", "op", "ref", "hyp", "n"]

    def run(batches):
        for batch in batches:
            pairs = Pairs(batch["ref"], batch["hyp"])
            n, _, op, at = pairs.steps()
            versions = pc.dictionary_encode(batch["version"], null_encoding="encode")
            items = [np.where(i < 0, 0, c[i] + 1) if len(c) else i + 1 for c, i in zip(pairs.codes, at, strict=True)]
            letters = np.unique(np.concatenate([[0], *items]))
            key = np.repeat(versions.indices.to_numpy(), n) * len(STEPS) + op
            for x in items:
                key = key * len(letters) + np.searchsorted(letters, x)
            key, count = np.unique(key, return_counts=True)
            key, h = np.divmod(key, len(letters))
            key, r = np.divmod(key, len(letters))
            v, op = np.divmod(key, len(STEPS))
            shown = pa.array([None, *(chr(x - 1) for x in letters[1:])], pa.string())
            columns = [versions.dictionary.take(pa.array(v)), pa.array(STEPS).take(pa.array(op)), shown.take(pa.array(r)), shown.take(pa.array(h)), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("version", side("text").alias("ref"), side("hyp").alias("hyp")).mapInArrow(run, "version string, op string, ref string, hyp string, n long")


def _wrong(op="op") -> Column:
    return (F.col(op) != "ok").cast("int")


def letter_errors(ops: DataFrame, model: str, baseline: str, least: int = 30) -> DataFrame:
    """Error rate of each letter for the model, its excess over the baseline, letters seen ``least`` times at least.

    ops: counted, as of letter_operations()."""
    seen = ops.where("ref is not null and ref <> ' '").groupBy("ref").pivot("version", [model, baseline]).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * _wrong()) / F.sum("n")).alias("rate"))
    out = seen.select("ref", F.col(f"{model}_n").alias("n"), F.round(f"{model}_rate", 6).alias("rate"), F.round(F.col(f"{model}_rate") - F.col(f"{baseline}_rate"), 6).alias("excess"))
    return out.where(F.col("n") >= least).orderBy(F.desc("excess"), "ref")


def confusions(ops: DataFrame, n: int = 25) -> DataFrame:
    """The letters most often taken for others; ops as of letter_operations()."""
    pairs = ops.where("ref is not null and ref <> ' ' and op <> 'ok'").groupBy("version", F.concat("ref", F.lit(">"), F.coalesce("hyp", F.lit("∅"))).alias("swap")).agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy("version").orderBy(F.desc("n"), "swap")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def model_only(rows: DataFrame, model: str, baseline: str, n: int = 40) -> DataFrame:
    """Words that the model misses and the baseline gets right in the same row; with the form first heard.

    rows: as of aligned(). Both versions of a row meet as lists, so words are only counted once they are chosen."""
    of = lambda version, keep: F.when(F.col("version") == version, F.filter("ops", keep))
    missed, right = of(model, lambda o: o["ref"].isNotNull() & (o["op"] != "ok")), F.transform(of(baseline, lambda o: o["op"] == "ok"), lambda o: o["ref"])
    both = rows.select("row_id", missed.alias("missed"), right.alias("right")).groupBy("row_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("missed", "right")))
    found = both.select("row_id", F.explode(F.filter("missed", lambda o: F.array_contains("right", o["ref"]))).alias("o"))
    return found.groupBy("o.ref").agg(F.count("*").alias("n"), F.min_by(F.coalesce("o.hyp", F.lit("∅")), F.struct("row_id", "o.pos")).alias("heard_as")).orderBy(F.desc("n"), "ref").limit(n)


def word_counts(rows: DataFrame, *also: str) -> DataFrame:
    """rows as of aligned() -> version, reference words, wrong operations, and the wrong ones of the first, middle and last word."""
    wrong = lambda o: (o["op"] != "ok").cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    out = rows.select("version", *also, total(F.transform("ops", wrong)).alias("wrong"), F.transform(F.filter("ops", lambda o: o["ref"].isNotNull()), wrong).alias("w")).withColumn("words", F.size("w").cast("long"))
    ends = {"first": F.when(F.col("words") > 0, F.element_at("w", 1)).otherwise(0), "last": F.when(F.col("words") > 1, F.element_at("w", -1)).otherwise(0)}
    return out.withColumns(ends).withColumn("middle", total("w") - F.col("first") - F.col("last")).drop("w")


def by_place() -> dict[str, tuple[Column, Column]]:
    """Wrong words and words of each place, summed over the rows of word_counts(); a lone word counts as first."""
    return {
        "first": (F.sum("first"), F.count_if(F.col("words") > 0)),
        "middle": (F.sum("middle"), F.sum(F.greatest(F.col("words") - 2, F.lit(0)))),
        "last": (F.sum("last"), F.count_if(F.col("words") > 1)),
    }


def position_errors(rows: DataFrame) -> DataFrame:
    """Error rate of the first, middle and last reference word; rows as of aligned()."""
    places = F.array(*(F.struct(F.lit(place).alias("place"), wrong.alias("wrong"), n.alias("n")) for place, (wrong, n) in by_place().items()))
    counted = word_counts(rows).groupBy("version").agg(places.alias("places")).select("version", F.inline("places")).where("n > 0")
    return counted.select("version", "place", F.round(F.col("wrong") / F.col("n"), 6).alias("rate"), "n")


@F.pandas_udf(RUNS)
def changed_runs(before: pd.Series, after: pd.Series) -> pd.Series:
    """Runs of words that a rewriting changed, by the longest common subsequence of words."""

    def runs(a, b):
        a, b = a.split(), b.split()
        out, left, right = [], [], []
        for step in alignment(a, b):
            if step["op"] == "ok":
                if left or right:
                    out.append({"before": " ".join(left), "after": " ".join(right)})
                left, right = [], []
                continue
            left += [step["ref"]] * (step["ref"] is not None)
            right += [step["hyp"]] * (step["hyp"] is not None)
        if left or right:
            out.append({"before": " ".join(left), "after": " ".join(right)})
        return out

    return pd.Series([runs(a or "", b or "") for a, b in zip(before, after, strict=True)])
