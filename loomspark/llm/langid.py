"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed byte n-grams (orders 1 to 4 of the lower-cased text), with log
counts and unit length. A first linear SVM, one against the rest, predicts the language *family*;
inside a family one-versus-one linear SVMs separate the languages, each pair voting with the
probability that its margin stands for. All weights are trained here, in numpy, by accelerated
gradient descent on the squared hinge loss.

Languages and families come from the labels: ``FAMILIES`` names the family of common language codes,
and a code that it doesn't name is a family of its own. The fit takes at most ``per_language`` labelled
texts of each language and ``most_rows`` in all, evenly (the only bounds; documented parameters). They are drawn by a
hash of the text among the different texts of a language, copies counting once, so ids that are null or repeated
and texts that are repeated change nothing; they are split 4:1 into training rows and rows on which the margins' slopes are calibrated. Prediction reads every
whole text, chunk by chunk, in Arrow batches, with a model of a few hundred kB in the closure.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts of any length are
used whole; ties go to the language that sorts first; without labelled rows everything is ``und``;
repeated rows are predicted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release_memory, bounded

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tk ky".split(),
    "indic": "hi bn ur pa gu mr ne si".split(),
    "semitic": "ar he mt am".split(),
    "austronesian": "id ms tl jv".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 12
ORDERS = (1, 2, 3, 4)
_DOCS = 512


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Unit vectors (documents x 2**bits, float32) of log counts of hashed byte n-grams inside each text."""
    n, dim = len(off) - 1, 1 << bits
    counts = np.zeros(n * dim, np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * dim, np.diff(off))
    h = np.zeros(len(raw), np.uint32)
    ends = np.repeat(off[1:], np.diff(off))
    for k in ORDERS:
        m = len(raw) - k + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:m] + raw[k - 1 :].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        inside = ends[:m] >= np.arange(k, m + k)
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        counts += np.bincount((doc[:m] + bucket)[inside], minlength=n * dim).astype(np.float32)
    x = np.log1p(counts.reshape(n, dim))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-9)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        i = batch.schema.get_field_index("text")
        batch = batch.set_column(i, "text", pc.utf8_lower(batch.column(i).cast(pa.large_string())))
        for part, raw, off in chunks([batch]):
            for at in range(0, len(off) - 1, _DOCS):
                o = off[at : at + _DOCS + 1]
                yield part.slice(at, len(o) - 1), features(raw[o[0] : o[-1]], o - o[0])


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def fit_svm(xb: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (columns of xb, outputs) of squared-hinge SVMs for targets y in {-1, 1}; 0 leaves a row out. xb has its bias column."""
    used = np.abs(y)
    share = used / np.maximum(1, used.sum(0))
    v = np.random.default_rng(1).standard_normal(xb.shape[1]).astype(np.float32)
    for _ in range(12):  # power iteration, for the step size
        v = xb.T @ (xb @ v)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    rate = 1 / (2 * norm * share.max(0) + reg)
    w = np.zeros((xb.shape[1], y.shape[1]), np.float32)
    z, t = w, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ z)) * used
        grad = -2 * xb.T @ (y * slack * share) + reg * z
        new = (z - rate * grad).astype(np.float32)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


def _slope(margin: np.ndarray, sign: np.ndarray) -> float:
    """The slope a for which sigmoid(a * margin) fits the signs best."""
    grid = np.geomspace(0.5, 30, 25)
    return float(min(grid, key=lambda a: np.logaddexp(0, -a * margin * sign).mean())) if len(margin) else 2.0


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    family_of: list[int] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    mean: np.ndarray | None = None
    family_w: np.ndarray | None = None
    pair_w: np.ndarray | None = None
    family_slope: float = 2.0
    pair_slope: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x languages: P(family) times the pairwise votes inside it; and the language chosen, family first."""
        x = x - self.mean
        xb = with_bias(x)
        if len(self.families) > 1:
            m = self.family_slope * 2 * (xb @ self.family_w)
            e = np.exp(m - m.max(1, keepdims=True))
            family = e / e.sum(1, keepdims=True)
        else:
            family = np.ones((len(x), 1))
        votes = np.ones((len(x), len(self.languages)))
        if self.pairs:
            margins = xb @ self.pair_w
            for k, (a, b) in enumerate(self.pairs):
                p = 1 / (1 + np.exp(-np.clip(self.pair_slope[k] * margins[:, k], -30, 30)))
                votes[:, a] *= p
                votes[:, b] *= 1 - p
        member = np.array(self.family_of)
        chosen = member[None, :] == family.argmax(1)[:, None]
        total = np.zeros((len(x), len(self.families)))
        for f in range(len(self.families)):
            total[:, f] = votes[:, member == f].sum(1)
        out = family[:, member] * votes / np.maximum(total[:, member], 1e-300)
        return out, np.where(chosen, out, -1.0).argmax(1)


def train(x: np.ndarray, langs: list[str], order: np.ndarray) -> LanguageModel:
    """x: rows of features and a last column for the bias, centred in place. order: a hash of each row; a fifth of the rows, by it, calibrates and doesn't train."""
    model = LanguageModel(languages=sorted(set(langs)))
    if not model.languages:
        return model
    codes = {c: i for i, c in enumerate(model.languages)}
    y = np.array([codes[c] for c in langs])
    family = [FAMILY_OF.get(c.split("-")[0].lower(), f"own:{c}") for c in model.languages]
    model.families = sorted(set(family))
    model.family_of = [model.families.index(f) for f in family]
    fam = np.array(model.family_of)[y]
    held = (order % 5 == 0) if len(y) >= 50 else np.zeros(len(y), bool)
    fit, check = ~held, held if held.any() else ~held
    model.mean = x[:, :-1].mean(0, where=fit[:, None], dtype=np.float64).astype(np.float32)
    x[:, :-1] -= model.mean
    x[:, -1] = 1
    if len(model.families) > 1:
        sign = np.where(fam[:, None] == np.arange(len(model.families)), 1.0, -1.0).astype(np.float32)
        model.family_w = fit_svm(x, sign * fit[:, None].astype(np.float32))
        model.family_slope = _slope((x[check] @ model.family_w).ravel(), sign[check].ravel())
    model.pairs = [(a, b) for a, b in combinations(range(len(codes)), 2) if model.family_of[a] == model.family_of[b]]
    if model.pairs:
        columns = []
        for a, b in model.pairs:  # a classifier sees the rows of its two languages alone
            own = fit & ((y == a) | (y == b))
            w = fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0).astype(np.float32)[:, None])
            near = check & ((y == a) | (y == b))
            columns.append(w)
            model.pair_slope.append(_slope((x[near] @ w)[:, 0], np.where(y[near] == a, 1.0, -1.0)))
        model.pair_w = np.hstack(columns)
    return model


def draw(labelled: DataFrame, per_language: int, most_rows: int) -> tuple[DataFrame | None, list[str], int]:
    """labelled (text, lang) -> ((lang, h, text) of different texts of each language, drawn by hash, up to about 1.4 times the bound; languages; the bound)."""
    rows = labelled.filter("lang is not null and lang <> '' and text is not null").select("lang", "text", F.xxhash64("text", F.lit(7)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return None, [], 0
    per_language = max(1, min(per_language, most_rows // len(counts)))
    part = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(1_000_000))
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1_000_000, 1_400_000 * per_language // max(1, n) + 1))]), F.col("lang"))
    return rows.filter(part < share).groupBy("lang", "h").agg(F.min("text").alias("text")), sorted(counts), per_language  # copies meet before they travel


def fit(labelled: DataFrame, per_language: int = 1000, most_rows: int = 20_000) -> LanguageModel:
    """labelled (text, lang) -> model, from at most ``per_language`` different texts of each language and ``most_rows`` in all."""
    sample, languages, per_language = draw(labelled, per_language, most_rows)
    if sample is None:
        return LanguageModel()

    def extract(batches):
        for part, x in featured(batches):
            packed = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("lang").cast(pa.string()), part.column("h"), packed], ["lang", "h", "x"])

    got = sample.mapInArrow(bounded(extract), "lang string, h long, x binary").toArrow()
    h = got.column("h").to_numpy()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    keep = np.concatenate([np.flatnonzero(langs == c)[np.argsort(h[langs == c], kind="stable")][:per_language] for c in languages]).astype(int)
    packed = got.column("x")
    x = np.ones((len(keep), (1 << BITS) + 1), np.float32)
    for i, k in enumerate(keep):
        x[i, :-1] = np.frombuffer(packed[int(k)].as_py(), np.float16)
    del got, packed
    model = train(x, list(langs[keep]), h[keep] & 0x7FFFFFFF)
    del x
    release_memory()
    return model


def _predict(model: LanguageModel, text: pa.Array, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether there is a letter, index of the language, score) of each row."""
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return np.zeros(len(x), bool), np.zeros(len(x), int), np.zeros(len(x))
    p, pick = model.probabilities(x)
    return lettered, pick, np.where(lettered, np.clip(p[np.arange(len(p)), pick], 0, 1), 0.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        for part, x in featured(batches):
            lettered, pick, score = _predict(model, part.column("text"), x)
            names = [model.languages[k] if ok else "und" for k, ok in zip(pick, lettered)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(bounded(predict), f"doc_id {kind}, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of ``least`` or more."""

    def run(batches):
        for batch in batches:
            at = 0
            for part, x in featured([batch]):
                lettered, _, score = _predict(model, part.column("text"), x)
                yield batch.slice(at, len(x)).filter(pa.array(lettered & (score >= least)))
                at += len(x)

    return docs.mapInArrow(bounded(run), docs.schema)
