"""Speaker attribution and identity: who says a word, and which face track a speaker is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.temporal import asof_nearest


def face_score(cues: Column | None = None) -> Column:
    """Area with a bonus for the centre; with cues the binding form, where mouth movement multiplies."""
    area = F.col("w") * F.col("h")
    off = F.sqrt(F.pow(F.col("x") + F.col("w") / 2 - 0.5, 2) + F.pow(F.col("y") + F.col("h") / 2 - 0.5, 2))
    centre = F.greatest(F.lit(0.0), 1 - off / 0.7071)
    return area + 0.05 * centre if cues is None else area * (1 + 0.2 * centre) * (1 + cues)


def confidence_grade(score: Column) -> Column:
    """Grades are compared in single precision."""
    s = score.cast("float")
    cut = lambda x: F.lit(x).cast("float")
    return (
        F.when(s >= cut(0.95), "VERIFIED").when(s >= cut(0.80), "STRONG").when(s >= cut(0.55), "AMBIGUOUS").when(s >= cut(0.30), "WEAK").otherwise("INVALID")
    )


def nearest_samples(words: DataFrame, samples: DataFrame) -> DataFrame:
    """Words with the sample nearest to them, null where none is within half a stride of the source and a little more."""
    stride = (F.max("t") - F.min("t")) / F.greatest(F.lit(1), F.count("*") - 1)
    reach = samples.groupBy("src").agg(F.greatest(F.lit(0.12), F.greatest(F.lit(0.01), stride) / 2 + 0.02).alias("reach"))
    return asof_nearest(words.join(reach, "src", "left"), samples.join(reach, "src"), by="src", t="t", key="word_id", pos="pos", tolerance="reach")


def attribute_words(words: DataFrame, samples: DataFrame, faces: DataFrame) -> DataFrame:
    """Words with the best face of the sample nearest to them; without a sample in reach, or with one without faces, OFFSCREEN."""
    near = nearest_samples(words, samples)
    scored = faces.select("pos", "track", face_score().alias("score"))
    best = scored.groupBy("pos").agg(F.max_by("track", F.struct("score", F.expr("-cast(substr(track, 2) as int)"))).alias("track"), F.count("*").alias("n_faces"))
    return near.join(best, "pos", "left").select("word_id", "src", "t", "pos", F.coalesce("track", F.lit("OFFSCREEN")).alias("track"), F.coalesce("n_faces", F.lit(0)).alias("n_faces"))


def labelled_speakers(words: DataFrame) -> DataFrame:
    """Words (src, track, t) to (src, track, first_t, n, label): dense labels T1, T2... in the order of first
    appearance; OFFSCREEN keeps its name and takes no number."""
    seen = words.groupBy("src", "track").agg(F.min("t").alias("first_t"), F.count("*").alias("n"))
    off = F.col("track") == "OFFSCREEN"
    number = F.row_number().over(Window.partitionBy("src", off).orderBy("first_t", "track"))
    return seen.withColumn("label", F.when(off, F.col("track")).otherwise(F.concat(F.lit("T"), number.cast("string"))))


def binding_weights(words: DataFrame, samples: DataFrame, faces: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Soft votes (src, speaker, track, weight): each word spreads its strength over the faces it sees."""
    near = asof_nearest(words.where("speaker is not null"), samples, by="src", t="t", key="word_id", pos="pos", tolerance=tolerance).where("pos is not null")
    seen = near.select("word_id", "src", "speaker", "pos").join(faces.select("pos", "track", face_score(F.col("mouth")).alias("score")), "pos")
    w = Window.partitionBy("word_id")
    spread = seen.withColumn("total", F.sum("score").over(w)).withColumn("strength", F.max("score").over(w) / F.col("total"))
    return spread.groupBy("src", "speaker", "track").agg(F.sum(F.col("strength") * F.col("score") / F.col("total")).alias("weight"))


def posteriors(weights: DataFrame, least: float = 0.2, margin: float = 0.15) -> DataFrame:
    """Edges (src, speaker, track, posterior, ambiguous) of at least ``least``."""
    speaker, track = Window.partitionBy("src", "speaker"), Window.partitionBy("src", "track")
    w = weights.withColumn("share", F.col("weight") / F.sum("weight").over(speaker)).withColumn("global", F.col("weight") / F.sum("weight").over(track))
    w = w.withColumn("assoc", F.pow(F.col("share") * F.col("global") * F.col("global"), 1.2))
    w = w.withColumn("posterior", F.col("assoc") / F.sum("assoc").over(speaker))
    ranked = speaker.orderBy(F.round(F.col("posterior"), 9).desc(), "track")
    second = F.max(F.when(F.col("n") == 2, F.col("posterior"))).over(speaker)
    w = w.withColumn("n", F.row_number().over(ranked)).withColumn("second", second).withColumn("top", F.max("posterior").over(speaker))
    return w.where(F.col("posterior") >= least).select("src", "speaker", "track", "posterior", (F.col("top") - F.coalesce("second", F.lit(0.0)) < margin).alias("ambiguous"))
