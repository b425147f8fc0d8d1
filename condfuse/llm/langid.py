"""Language identification with a string kernel.

The kernel of two texts is the share of character n-grams (of all lengths 1 to 3 together) that are
present in both, normalised to 1 for equal sets.  Nystroem landmarks turn it into features and kernel ridge regression fits
one score per language against the rest.  Prediction is two matrix products per block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condfuse.llm.common import text_of

BITS = 14  # n-grams fall into 2**BITS presence slots
BLOCK = 256  # texts per matrix product
PIECE = 1 << 20  # characters of a text handled at once
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(text: str, out: np.ndarray) -> bool:
    """Set the slots of the text's n-grams in ``out``; whether it has a letter.

    Letters are lower-cased and what lies between them counts as one space.  The whole text is read,
    a piece at a time.
    """
    table, any_letter = _letter_table(), False
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[max(0, at - 2) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[points]
        any_letter = any_letter or bool(letter.any())
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.where(letter, points, np.uint32(32))[keep]
        shift = np.uint32(32 - BITS)
        out[(c * np.uint32(2654435769)) >> shift] = 1
        if len(c) > 1:
            two = (c[:-1] * np.uint32(2246822519)) ^ (c[1:] * np.uint32(3266489917))
            out[(two * np.uint32(2654435769)) >> shift] = 1
            if len(c) > 2:
                three = (two[:-1] * np.uint32(374761393)) ^ (c[2:] * np.uint32(668265263))
                out[(three * np.uint32(2654435769)) >> shift] = 1
    return any_letter


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: a quarter by the checksum of the id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, *, sample: int = 2048, landmarks: int = 128, ridge: float = 0.3) -> dict | None:
    """The model from a bounded sample of the labelled rows that are not held out.

    ``sample`` bounds the rows over all languages, ``landmarks`` those kept as Nystroem points; each language
    gives an equal part of both, its rows with the smallest id hash.  Of more than ``landmarks`` languages
    those with most labelled rows are learned (ties: code-point order).  None if no row is labelled.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(min(landmarks, sample)).collect()  # one row per language
    if not counts:
        return None
    quota = max(1, sample // len(counts))
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 3 * quota / r["count"] + 0.0)) for r in counts], "_lang string, share double"))
    near = rows.join(share, F.col("lang") == F.col("_lang")).where(u < F.col("share")).select("lang", u.alias("u"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("raw"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for raw in batch.column(3):
                out = np.zeros(1 << BITS, np.uint8)
                bits.append(np.packbits(out).tobytes() if presence(raw.as_py().decode("utf-8", "replace"), out) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bits, pa.binary())], ["lang", "u", "h", "bits"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))  # at most about 3 * quota rows each
    got = near.mapInArrow(features, "lang string, u double, h long, bits binary").where("bits IS NOT NULL").withColumn("place", place).where(F.col("place") <= quota).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["place"]))
    names = sorted({r["lang"] for r in got})
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in got])
    y = np.array([[r["lang"] == n for n in names] for r in got], float)
    per = max(1, landmarks // len(names))
    unpacked = lambda bits: np.unpackbits(bits, axis=1).astype(np.float32)
    chosen = packed[[i for i, r in enumerate(got) if r["place"] <= per]]
    points = unpacked(chosen)
    kernel = np.vstack([_kernel(unpacked(packed[at : at + BLOCK]), points) for at in range(0, len(packed), BLOCK)])
    vals, vecs = np.linalg.eigh(_kernel(points, points).astype(float))
    root = vecs / np.sqrt(np.maximum(vals, 1e-6))
    phi = np.hstack([kernel @ root, np.ones((len(packed), 1))])
    even = (1 / (y * y.sum(0)).sum(1))[:, None]  # languages count alike
    penalty = np.diag([ridge / len(names) / 10] * root.shape[1] + [1e-9])
    w = np.linalg.solve(phi.T @ (phi * even) + penalty, phi.T @ (y * even))
    return {"names": names, "points": chosen, "weights": root @ w[:-1], "bias": w[-1]}


def _kernel(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (x @ points.T) / np.sqrt(np.maximum(np.outer(x.sum(1), points.sum(1)), 1))


def identify(docs: DataFrame, model: dict | None = None, *, names: tuple[str, str, str] = ("held_out", "lang_pred", "score"), **bounds) -> DataFrame:
    """``docs`` and ``held_out, lang_pred, score``; the model is fitted on ``docs`` unless given.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a text that is null or has no letter, and
    for every text if nothing could be learned.  Equal scores go to the first language in code-point order.
    ``score`` is the regression value, held to 0 to 1.  Rows are independent, repeated rows give repeated results, an empty table
    none; columns of the three ``names`` are replaced, the others pass through.
    """
    model = model or fit(docs, **bounds)
    docs = docs.drop(*names)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.unpackbits(model["points"], axis=1).astype(np.float32) if model else None
        x = np.zeros((BLOCK, 1 << BITS), np.float32)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), BLOCK):
                batch = whole.slice(at, BLOCK)
                x[:] = 0
                text = batch.column(batch.schema.get_field_index("text"))
                known = [t.is_valid and presence(text_of(t), x[i]) for i, t in enumerate(text)]
                if model:
                    values = np.clip(_kernel(x[: len(known)], points) @ model["weights"] + model["bias"], 0, 1)
                    best = values.argmax(1) if len(known) else []
                    lang = [model["names"][b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = [float(values[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
                else:
                    lang, score = [UNKNOWN] * len(known), [0.0] * len(known)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names[1:]])

    rows = docs.withColumn(names[0], held_out(F.col("doc_id")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(predict, f"{kinds}, `{names[1]}` string, `{names[2]}` double")
