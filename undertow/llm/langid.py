"""Language identification in two steps: the family first, then the language within it.

Both steps are linear support vector machines over hashed byte 2-grams and 3-grams of the lower-cased
text: one-versus-rest for the family, one-versus-one within it. There each pair of languages has a machine
trained on those two alone; the language of most votes wins, of equal ones that of the largest sum of margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import texts_in, written

DIM = 4096
#: Training rows: about TRAIN_ROWS in all, dealt evenly to all languages, at most PER_LANG and at least LEAST_LANG each
#: (fewer only if a language has no more), so that beyond TRAIN_ROWS / LEAST_LANG languages the sample grows with their number.
TRAIN_ROWS, PER_LANG, LEAST_LANG = 6000, 1200, 50
#: Share of labelled rows that the margin of a clear language may lose, and the bounds of that margin: under 0 all machines say no.
CLEAR_LOST, CLEAR_LEAST, CLEAR_MOST = 0.001, 0.0, 0.5
CLEAR_STEPS = 10_000  # of a margin of 1
#: Families of ISO 639-1 codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ur ne pa gu ta te",
    "sinitic": "zh yue",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters all become a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_S = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram shares, scaled to length 1, over the whole text."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIM, np.float32)
    two = b[:-1] * np.uint32(257) + b[1:]
    counts = np.bincount((two * _S[0]) >> np.uint32(20), minlength=DIM)
    three = two[:-1] * np.uint32(263) + b[2:]
    counts += np.bincount((three * _S[1] ^ _S[2]) * _S[0] >> np.uint32(20), minlength=DIM)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150, reg: float = 1e-4) -> np.ndarray:
    """One-versus-rest machines by accelerated gradient on the squared hinge; rows of (classes, DIM + 1).

    Rows are weighted so that each class counts alike.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    if classes < 2:
        return np.zeros((classes, x.shape[1]), np.float32)
    target = np.where(y[:, None] == np.arange(classes), 1.0, -1.0).astype(np.float32)
    share = np.bincount(y, minlength=classes).clip(1)
    weight = (1.0 / (classes * share[y])).astype(np.float32)[:, None]
    w = look = np.zeros((x.shape[1], classes), np.float32)
    rate, t = 1.0 / (4.0 + reg), 1.0
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - target * (x @ look))
        grad = x.T @ (-2.0 * weight * target * slack) + reg * look
        new = look - rate * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + ((t - 1) / t2) * (new - w), new, t2
    return w.T.astype(np.float32)


def pairs(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def vote(margins: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """The winner of n languages and each one's mean margin; ``margins`` are those of ``pairs``, for the first over the second."""
    votes, sums = np.zeros(n), np.zeros(n)
    for (a, b), m in zip(pairs(n), margins, strict=True):
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    best = np.flatnonzero(votes == votes.max())
    return int(best[sums[best].argmax()]), sums / max(1, n - 1)


class Model:
    """``within`` has for each family the machines of its pairs of languages; ``rest`` has one machine a language
    against all others. Those tell how clear a text is: below ``limit`` its best margin is no known language's."""

    def __init__(self, langs: list[str], families: list[list[int]], top: np.ndarray, within: list[np.ndarray], rest: np.ndarray, limit: float) -> None:
        self.langs, self.families, self.top, self.within, self.rest, self.limit = langs, families, top, within, rest, limit

    @staticmethod
    def _shares(margins: np.ndarray) -> np.ndarray:
        e = np.exp(4.0 * (margins - margins.max()))
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and best margin of one language against the rest."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, float("-inf")
        x = np.append(features(text), np.float32(1))
        family = self._shares(self.top @ x)
        f = int(family.argmax())
        k, means = vote(self.within[f] @ x, len(self.families[f]))
        own = self._shares(means)
        return self.langs[self.families[f][k]], float(family[f] * own[k]), float((self.rest @ x).max())


def clear_machines(x: np.ndarray, y: np.ndarray, fold: np.ndarray, classes: int) -> list[np.ndarray]:
    """For each of two folds the machines of all languages, trained on rows of the other fold."""
    return [svm(x[fold != f], y[fold != f], classes) for f in (0, 1)]


def clear_limit(labelled: DataFrame, langs: list[str], machines: list[np.ndarray], text: str, label: str, key: str) -> float:
    """The margin over which all but CLEAR_LOST of all the labelled rows lie, in steps of 1 / CLEAR_STEPS, each told for its
    own language by the machines that no row of its fold has trained; see CLEAR_LEAST. The driver gets counts by step."""
    shared = labelled.sparkSession.sparkContext.broadcast(({lang: i for i, lang in enumerate(langs)}, machines))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        for batch in texts_in(batches):
            rows = zip(batch.column(text).to_pylist(), batch.column(label).to_pylist(), batch.column("_fold").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([float(w[f][at[lang]] @ np.append(features(t), np.float32(1))) for t, lang, f in rows if lang in at], pa.float64())], names=["margin"])

    told = labelled.select(text, label, fold_of(key).alias("_fold")).mapInArrow(own, "margin double")
    step = F.floor(F.least(F.greatest("margin", F.lit(CLEAR_LEAST)), F.lit(CLEAR_MOST)) * CLEAR_STEPS)
    counts = sorted((r["step"], r["count"]) for r in told.groupBy(step.alias("step")).count().collect())  # at most CLEAR_MOST * CLEAR_STEPS + 1
    room = CLEAR_LOST * sum(n for _, n in counts)
    for at, n in counts:
        room -= n
        if room < 0:
            return at / CLEAR_STEPS
    return CLEAR_LEAST


def train(rows: list[tuple[np.ndarray, str]], clear: bool = False) -> Model:
    """With ``clear`` also the machines that tell how clear a text is; the limit follows from all labelled rows."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], [], np.zeros((0, DIM + 1), np.float32), [], np.zeros((0, DIM + 1), np.float32), 0.0)
    names = sorted({FAMILY_OF.get(lang, lang) for lang in langs})
    families = [[i for i, lang in enumerate(langs) if FAMILY_OF.get(lang, lang) == name] for name in names]
    x = np.stack([v for v, _ in rows])
    y = np.array([langs.index(lang) for _, lang in rows])
    family = np.array([next(f for f, own in enumerate(families) if i in own) for i in range(len(langs))])[y]
    within = []
    for own in families:
        machines = np.zeros((len(pairs(len(own))), DIM + 1), np.float32)
        for i, (a, b) in enumerate(pairs(len(own))):
            mine = np.isin(y, (own[a], own[b]))
            machines[i] = svm(x[mine], (y[mine] == own[b]).astype(np.int64), 2)[0]
        within.append(machines)
    rest = svm(x, y, len(langs)) if clear else np.zeros((1, DIM + 1), np.float32)
    return Model(langs, families, svm(x, family, len(families)), within, rest, CLEAR_LEAST)


def fold_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(2)).cast("int")


def fit_languages(labelled: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", clear: bool = False) -> Model:
    """Trains on a bounded sample of ``labelled`` rows, chosen by a hash of the key: see TRAIN_ROWS.

    The sample's feature vectors (whole texts) meet in one task; the weights come to the driver. With ``clear`` all
    labelled rows then tell the limit.
    """
    labelled = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = written(labelled.groupBy(label).agg(F.count("*").alias("_n")), "langid-counts")  # one row a language
    if not (n_langs := counts.count()):
        return train([])
    each = max(LEAST_LANG, min(PER_LANG, TRAIN_ROWS // n_langs))
    share = F.least(F.lit(1.0), F.lit(each) / F.col("_n"))
    chosen = labelled.join(F.broadcast(counts), label).where(F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1_000_000)) < share * 1_000_000).select(text, label, F.xxhash64(key).alias("_order"), fold_of(key).alias("_fold"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_in(batches, 256):
            v = [features(t).tobytes() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), batch.column(label), batch.column("_order"), batch.column("_fold")], names=["v", "lang", "o", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(v, np.float32), lang, f) for b in batches for v, lang, f in zip(*(b.column(c).to_pylist() for c in ("v", "lang", "f")), strict=True)]
        import pickle

        model, machines = train([(v, lang) for v, lang, _ in seen], clear), []
        if clear and seen:
            machines = clear_machines(np.stack([v for v, _, _ in seen]), np.array([model.langs.index(lang) for _, lang, _ in seen]), np.array([f for _, _, f in seen]), len(model.langs))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, machines))], pa.binary())], names=["model"])

    sample = written(chosen.mapInArrow(vectors, "v binary, lang string, o long, f int"), "langid-sample")
    fitted = sample.repartition(1).sortWithinPartitions("o", "lang").mapInArrow(fit, "model binary").collect()
    import pickle

    model, machines = pickle.loads(fitted[0][0]) if fitted else (train([]), [])
    if machines:
        model.limit = clear_limit(labelled, model.langs, machines, text, label, key)
    return model


def predict_languages(docs: DataFrame, model: Model, *, text: str = "text", columns: list[str] | None = None, margin: bool = False) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``, and ``margin`` if asked for. Null texts and texts without a letter are ``und`` with score 0.

    Without training rows all are. Repeated rows get equal results; ``columns`` names those of ``docs``
    to return (all by default), columns named as the new ones are replaced.
    """
    new = ["lang_pred", "score", "margin"][: 3 if margin else 2]
    keep = [c for c in (columns or docs.columns) if c not in new]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in new)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_in(batches):
            told = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array([t[i] for t in told], pa.float64() if i else pa.string()) for i in range(len(new)))],
                names=[*keep, *new],
            )

    return docs.mapInArrow(run, schema)


def held_out(key: str, folds: int, fold: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def report(docs: DataFrame) -> DataFrame:
    """The columns of op8's contract. A null doc_id is in no fold: it neither trains nor is held out."""
    held = held_out("doc_id", 5, 0)
    model = fit_languages(docs.where(~held))
    told = predict_languages(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return told.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
