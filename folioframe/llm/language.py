"""Language identification in two steps: family, then one-versus-one linear support vector machines inside the family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioframe.llm.arrowtext import LOWER, chunks, mix
from folioframe.llm.common import row_key

#: Rows learned from for each language at most (about, by hash), and for all languages together; hashed n-gram features; languages learned.
LANG_ROWS, ALL_ROWS, DIM, LANGS = 1500, 30_000, 1024, 500
FOLDS, HELD = 4, 2
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a language that isn't listed is in a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "sinitic": "zh yue",
}


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in families.items() if code in codes.split()), f"={lang}")


_FOLD = LOWER.copy()
_FOLD[[c for c in range(0x80) if not chr(c).isalpha()]] = 0x20


def ngram_features(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams, of unit length; A-Z lower-cased, ASCII non-letters as blanks."""
    out = np.zeros((len(column), dim), np.float32)
    for lo, hi, raw, off in chunks(column):
        buf = _FOLD[raw].astype(np.uint64)
        doc = np.repeat(np.arange(hi - lo), np.diff(off))
        counts = np.zeros((hi - lo) * dim)
        for n in (1, 2, 3):
            if len(buf) < n:
                continue
            code = np.full(len(buf) - n + 1, n, np.uint64)
            for i in range(n):
                code = code * np.uint64(256) + buf[i : len(buf) - n + 1 + i]
            inside = doc[: len(code)] == doc[n - 1 :]
            slot = (mix(code) % np.uint64(dim)).astype(np.int64) + doc[: len(code)] * dim
            counts += np.bincount(slot[inside], minlength=len(counts))
        x = np.sqrt(counts.reshape(hi - lo, dim))
        out[lo:hi] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 500.0, steps: int = 30) -> np.ndarray:
    """Primal linear SVM with squared hinge by Newton's method; each system by conjugate gradients. y is -1 or 1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = c / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))  # both classes weigh the same
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        miss = 1 - y * (x @ w)
        act = miss > 0
        grad = w - x[act].T @ (weight[act] * y[act] * miss[act])
        if np.linalg.norm(grad) < 1e-4 * max(1.0, np.linalg.norm(w)):
            break
        xa, wa = x[act], weight[act]
        d, r = np.zeros_like(w), -grad
        p, rr = r.copy(), r @ r
        for _ in range(60):
            hp = p + xa.T @ (wa * (xa @ p))
            a = rr / (p @ hp)
            d += a * p
            r -= a * hp
            new = r @ r
            if new < 1e-10 * (grad @ grad):
                break
            p, rr = r + new / rr * p, new
        w = w + d
    return w


class Model:
    def __init__(self, langs: list[str], weights: dict[tuple[str, str], np.ndarray]):
        self.langs = sorted(langs)
        self.family = {lang: family_of(lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        self.weights = weights

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the family of largest margin, then the language with most pairwise wins, ties by summed margins."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), x.dtype)])
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        fam, score = np.zeros(n, np.int64), np.ones(n)
        if len(self.families) > 1:
            m = np.stack([x @ self.weights[(None, f)] for f in self.families], 1)
            fam = m.argmax(1)
            top = np.sort(m, 1)
            score = sure(top[:, -1] - top[:, -2])
        lang = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(fam == i)
            own = [x for x in self.langs if self.family[x] == f]
            wins, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                m = x[rows] @ self.weights[(own[a], own[b])]
                wins[:, a] += m > 0
                wins[:, b] += m <= 0
                sums[:, a] += sure(m)
                sums[:, b] += sure(-m)
            best = np.lexsort((sums, wins), axis=1)[:, -1] if len(own) > 1 else np.zeros(len(rows), np.int64)
            lang[rows] = np.array(own, object)[best] if len(rows) else []
            if len(own) > 1:
                score[rows] *= sums[np.arange(len(rows)), best] / (len(own) - 1)
        return lang, np.clip(score, 0, 1)


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, per_lang: int = LANG_ROWS, in_all: int = ALL_ROWS) -> Model:
    """Learns from a hash sample of the documents outside the held-out fold whose text and lang aren't null.

    Each two-class problem (a family against the others, two languages of a family) is a group of its own, trained in one task
    from at most about ``in_all`` rows of DIM floats. The LANGS languages of most rows are learned.
    """
    own = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold() != HELD))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return Model([], {})
    model = Model(list(counts), {})
    cap = max(20, min(per_lang, in_all // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, -(-n // cap)))])
    rows = own.filter(F.pmod(row_key(), share[F.col("lang")]) == 0).select("lang", "text")
    # A problem is a pair: (None, family) or two languages.
    asked = [(None, f) for f in model.families if len(model.families) > 1]
    problems = {lang: list(range(len(asked))) for lang in counts}
    for f in model.families:
        for a, b in combinations([x for x in model.langs if model.family[x] == f], 2):
            problems[a].append(len(asked))
            problems[b].append(len(asked))
            asked.append((a, b))
    family = model.family

    def encode(batches):
        for batch in batches:
            x = ngram_features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array([problems[v] for v in batch.column(0).to_pylist()], pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "problem", "x"])

    def fit(t: pa.Table) -> pa.Table:
        number = t.column("problem")[0].as_py()
        a, b = asked[number]
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(t.num_rows, -1)
        is_a = np.array([(family[v] == b) if a is None else (v == a) for v in t.column("lang").to_pylist()])
        return pa.table({"problem": pa.array([number], pa.int32()), "w": pa.array([fit_svm(x, np.where(is_a, 1.0, -1.0)).tobytes()], pa.binary())})

    coded = rows.mapInArrow(encode, "lang string, problem array<int>, x binary").select("lang", F.explode("problem").alias("problem"), "x")
    for r in coded.groupBy("problem").applyInArrow(fit, "problem int, w binary").collect():
        model.weights[asked[r.problem]] = np.frombuffer(r.w, np.float64)
    return model


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn from. Null doc_ids
    are in the fold of the empty string. lang, source and other columns are never looked at when predicting; equal texts, and so repeated rows,
    get equal predictions, and a tie goes to the language that sorts last. A lang may be any string; the empty one is a language like others.
    """
    model = train(docs)

    def run(batches):
        for batch in batches:
            if model.langs:
                lang, score = model.predict(ngram_features(batch.column(1)))
            else:
                lang, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lettered", "lang", "score"])

    s = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered")).mapInArrow(run, docs.select("doc_id").schema.add("lettered", "boolean").add("lang", "string").add("score", "double"))
    return s.select("doc_id", (fold() == HELD).alias("held_out"), F.when(F.col("lettered"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))
