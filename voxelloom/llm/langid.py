"""Language identification in two steps: a family first, then one-versus-one linear support vector machines inside it.

Features are hashed byte n-grams (1 to 4 bytes, lower-cased ASCII, word edges as blanks), counted over whole texts in blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm import words as W
from voxelloom.llm.setup import aside

#: Language codes (ISO 639-1) by family.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
    "turkic": ("tr", "az", "kk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "ur", "mr"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "semitic": ("ar", "he"),
}
UNKNOWN = "und"
#: Hashed features of each n-gram length.
BITS = 12
ORDERS = (1, 2, 3, 4)
SIZE = len(ORDERS) << BITS
_LETTER = regex.compile(r"\p{L}")
ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def grams(data: np.ndarray) -> np.ndarray:
    """(orders, bytes) feature of the n-gram that ends at each byte; `data` is lower-cased with blanks as one value."""
    wide = data.astype(np.uint32)
    code = np.zeros(len(data), dtype=np.uint32)
    out = np.empty((len(ORDERS), len(data)), dtype=np.int32)
    for i, n in enumerate(ORDERS):
        back = np.full(len(data), 32, dtype=np.uint32)
        back[n - 1:] = wide[:len(data) - n + 1] if n <= len(data) else 32
        code = code + back * np.uint32((1, 257, 65537 * 3, 16777619)[i])
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out[i] = (mixed >> np.uint32(32 - BITS)).astype(np.int32) + (i << BITS)
    return out


#: ASCII letters lower-cased; every other ASCII byte is a blank.
_FOLD = W.LOWER.copy()
_FOLD[[b for b in range(128) if not 0x61 <= int(W.LOWER[b]) <= 0x7A]] = 32


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without repeated blanks, a blank before each text, and the new offsets."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    at = kept + np.arange(len(kept))
    out = np.full(int(at[-1]), 32, dtype=np.uint8)
    spot = np.ones(len(out), dtype=bool)
    spot[at[:-1]] = False
    out[spot] = folded[keep]
    return out, at


def counts(data: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """How often each feature occurs in one folded text."""
    out = np.zeros(SIZE, dtype=np.int64)
    for at in range(0, len(data), block):
        lead = max(at - 3, 0)
        out += np.bincount(grams(data[lead:at + block])[:, at - lead:].ravel(), minlength=SIZE)
    return out


def excerpts(data: np.ndarray, sizes: tuple[int, ...] = (1, 2, 4, 10, 30)) -> list[np.ndarray]:
    """A folded text and runs of a few of its words from different places, so that short texts are learned too."""
    out = [data]
    blank = np.flatnonzero(data == 32)
    for i, size in enumerate(sizes):
        if len(blank) > 2 * size:
            at = (len(blank) - size) * (i + 1) // (len(sizes) + 1)
            out.append(data[blank[at]:blank[at + size]])
    return out


def svm(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss) by dual coordinate descent; the last weight is the bias."""
    w = np.zeros(SIZE)
    bias = 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            gradient = label[i] * (float(w[at] @ value) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), float(weight[i]))
            step = (new - alpha[i]) * label[i]
            if step:
                w[at] += step * value
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """One-versus-rest machines over families, one-versus-one machines over the languages of a family."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({lang for lang, _, _ in samples})
        self.families = sorted({family(lang) for lang in self.langs})
        langs = np.array([lang for lang, _, _ in samples])
        of = np.array([family(lang) for lang in langs])
        # a common feature says little: shares are scaled by the inverse root of the feature's mean share
        mean = np.full(SIZE, 1e-6)
        for _, at, value in samples:
            mean[at] += value / max(len(samples), 1)
        self.scale = 1.0 / np.sqrt(mean)
        rows = []
        for _, at, value in samples:
            scaled = value * self.scale[at]
            rows.append((at, scaled / max(float(np.sqrt(scaled @ scaled)), 1e-9)))
        self.tasks, tables, biases = [], [], []

        def learn(kind, chosen, positive):
            y = np.where(positive, 1.0, -1.0)
            share = np.where(positive, 1 / max(positive.sum(), 1), 1 / max((~positive).sum(), 1)) * len(y) / 2
            w, b = svm([rows[i] for i in chosen], y, 10.0 * share)
            self.tasks.append(kind)
            tables.append(w * self.scale)
            biases.append(b)

        if len(self.families) > 1:
            for name in self.families if len(self.families) > 2 else self.families[:1]:
                learn(("family", name), np.arange(len(rows)), of == name)
        for name in self.families:
            for a, b in combinations([x for x in self.langs if family(x) == name], 2):
                chosen = np.flatnonzero((langs == a) | (langs == b))
                learn(("pair", a, b), chosen, langs[chosen] == a)
        self.table = np.stack(tables, 1).astype(np.float32) if tables else np.zeros((SIZE, 0), np.float32)
        self.bias = np.array(biases)
        self.square = (self.scale ** 2).astype(np.float32)

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of texts from the margins of all machines."""
        sure = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
        column = {kind: i for i, kind in enumerate(self.tasks)}
        n = len(margins)
        if len(self.families) == 1:
            chance = np.ones((n, 1))
        elif len(self.families) == 2:
            p = sure[:, column[("family", self.families[0])]]
            chance = np.stack((p, 1 - p), 1)
        else:
            p = np.stack([sure[:, column[("family", x)]] for x in self.families], 1)
            chance = p / p.sum(1, keepdims=True)
        first = chance.argmax(1)
        lang, score = np.empty(n, dtype=object), np.zeros(n)
        for f, name in enumerate(self.families):
            here = np.flatnonzero(first == f)
            members = [x for x in self.langs if family(x) == name]
            votes = np.zeros((len(here), len(members)))
            for i, j in combinations(range(len(members)), 2):
                p = sure[here, column[("pair", members[i], members[j])]]
                votes[:, i] += p
                votes[:, j] += 1 - p
            best = votes.argmax(1)
            lang[here] = np.array(members, dtype=object)[best]
            inside = votes.max(1) / (len(members) - 1) if len(members) > 1 else 1.0
            score[here] = chance[here, f] * inside
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margins of folded texts; like the training rows a text has length one."""
    out = np.zeros((len(offsets) - 1, len(model.bias)))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        n = counts(data[a:b]).astype(np.float32)
        out[i] = n @ model.table / max(math.sqrt(float(n * n @ model.square)), 1e-9)
    return out + model.bias


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600) -> Model | None:
    """Model learned from labelled rows; None when there is no label.

    About `per_language` rows of each language at most are learned from: first every different text once, by its hash, then
    second copies of repeated ones, and so on until there are enough; so a text that fills a language is learned, and not
    more often than that.  The bound is the only limit, everything else covers all rows.  Every sampled text gives itself and
    a few short excerpts.  Labels are few: `per_language` small rows a label at most, and the sample, go to the driver.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    copies = labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.least(F.count("*"), F.lit(per_language)).alias("n"))
    sizes: dict[str, dict[int, int]] = {}
    for r in copies.groupBy("lang", "n").count().collect():
        sizes.setdefault(r["lang"], {})[r["n"]] = r["count"]
    if not sizes:
        return None
    top = (1 << 63) - 1
    whole, share = {}, {}  # how many copies of every text are taken, and up to which hash one more
    for name, known in sizes.items():
        left, taken = per_language, 0
        while (more := sum(k for n, k in known.items() if n > taken)) and more <= left:
            left, taken = left - more, taken + 1
        whole[name], share[name] = taken, top * left // more if more else top

    def by_label(values: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    rank = F.xxhash64("text").bitwiseAND(F.lit(top))
    near = (rank <= by_label(share)) | (by_label(whole) > 0)
    chosen = labelled.where(near).groupBy("lang", "text").agg(F.count("*").alias("n"))
    one_more = ((F.col("n") > by_label(whole)) & (rank <= by_label(share))).cast("long")
    chosen = chosen.select("lang", "text", (F.least(F.col("n"), by_label(whole).cast("long")) + one_more).alias("times"))

    def features(batches):
        for batch in batches:
            data, offsets = fold(*W.flat(batch.column(1)))
            out = []
            for name, a, b, times in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist()):
                for piece in excerpts(data[a:b]):
                    n = counts(piece)
                    at = np.flatnonzero(n)
                    if len(at):
                        out += [(name, at.astype(np.int16).tobytes(), (n[at] / len(piece)).astype(np.float16).tobytes())] * times
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                                             names=["lang", "at", "value"])

    rows = chosen.mapInArrow(features, "lang string, at binary, value binary").collect()
    samples = [(r[0], np.frombuffer(bytes(r[1]), np.int16).astype(np.int32), np.frombuffer(bytes(r[2]), np.float16).astype(np.float32)) for r in rows]
    return Model(sorted(samples, key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))) if samples else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows of `docs` with lang_pred and score (0 to 1); only the whole text is looked at.

    `und` with score 0 for a null text, one without a letter, or without a model.  Columns of these names are replaced.
    """
    kept = docs.drop(*ADDED.names)
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for a set of languages

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in W.slices(whole, text):
                column = batch.column(batch.schema.get_field_index(text))
                raw, at = W.flat(column)
                data, offsets = fold(raw, at)
                lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if model is not None:
                    ascii_letter = np.concatenate(([0], np.cumsum((data >= 0x61) & (data <= 0x7A))))[offsets]
                    wide = np.concatenate(([0], np.cumsum(data >= 0x80)))[offsets]
                    some = (np.diff(ascii_letter) > 0) | (np.diff(wide) > 0)
                    for i in np.flatnonzero(some & (np.diff(ascii_letter) == 0)):
                        some[i] = _LETTER.search(column[i].as_py()) is not None
                    lang, score = model.decide(margins(model, data, offsets))
                    lang = [x if ok else UNKNOWN for x, ok in zip(lang, some)]
                    score = np.where(some, score, 0.0)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, *ADDED.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *ADDED.fields]))


def clean(docs: DataFrame, model: Model | None, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language can be told (not `und`, score of `min_score` or more), unchanged."""
    moved, columns = aside(docs, ADDED.names)
    told = predict(moved, model, text)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*columns.values())
