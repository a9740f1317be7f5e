"""Queries whose result depends on the rows before in order; SQL has no form for most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import attribution as A
from tessera.operators import blocks, folds
from tessera.plans.aggregate_queries import NEAR_SQL, REACH_SQL, SCORE_SQL
from tessera.plans.registry import Registry
from tessera.plans.temporal_queries import GATED, words_in_speech
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    "punch_in_spacing",
    V.ctes("samples") + """, b AS (SELECT src, t, pos, row_number() OVER (PARTITION BY src ORDER BY t, pos) AS n FROM samples WHERE luma > 0.05),
      r AS (SELECT src, n, t AS last, t, pos, TRUE AS kept FROM b WHERE n = 1 UNION ALL SELECT b.src, b.n, CASE WHEN b.t - r.last >= 3 THEN b.t ELSE r.last END, b.t, b.pos, b.t - r.last >= 3 FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1)
      SELECT src, pos FROM r WHERE kept""",
)
def punch_in_spacing(spark, d):
    beats = V.samples(spark, d).where("luma > 0.05")
    return blocks.spaced(beats, by="src", t="t", key="pos", gap=3.0).select("src", "pos")


CANDIDATES = REACH_SQL + f""", cand AS (SELECT pos, list(track ORDER BY s DESC, track) AS tracks, list(s ORDER BY s DESC, track) AS scores FROM (SELECT pos, track, {SCORE_SQL} AS s FROM faces) z GROUP BY pos),
      asked AS (SELECT n.src, n.word_id, n.t, coalesce(c.tracks, ['OFFSCREEN']) AS tracks, coalesce(c.scores, [1.0::DOUBLE]) AS scores FROM within n LEFT JOIN cand c USING (pos))"""
STICKY = """b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY word_id) AS n FROM {source}),
      r AS (SELECT src, n, word_id, t, tracks[1] AS track FROM b WHERE n = 1 UNION ALL
        SELECT b.src, b.n, b.word_id, b.t, CASE WHEN list_contains(b.tracks, r.track) AND b.scores[1] < b.scores[list_position(b.tracks, r.track)] * 1.15 + 0.005 THEN r.track ELSE b.tracks[1] END
        FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1)"""


def candidates(spark, d, words):
    """Words with the faces that may speak them, and their scores."""
    near = A.nearest_samples(words, V.samples(spark, d))
    seen = V.faces(spark, d).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("track", A.face_score().alias("score")))).alias("f"))
    return near.join(seen, "pos", "left").select("src", "word_id", "t", F.col("f.track").alias("tracks"), F.col("f.score").alias("scores"))


@query("sticky_speaker", V.ctes("words", "samples", "faces") + ", " + CANDIDATES + ", " + STICKY.format(source="asked") + " SELECT src, word_id, track FROM r")
def sticky_speaker(spark, d):
    return folds.sticky_speaker(candidates(spark, d, V.words(spark, d)))


@query(
    "speaker_diarization",
    V.ctes("words", "samples", "faces", "segments") + ", " + CANDIDATES + "," + GATED
    + """, free AS (SELECT src FROM lvl WHERE n1 + n2 > 0), heard AS (SELECT a.* FROM asked a WHERE a.src NOT IN (SELECT src FROM free) OR EXISTS (SELECT 1 FROM g WHERE g.src = a.src AND a.t >= g."start" AND a.t < g."end")), """
    + STICKY.format(source="heard")
    + """, f AS (SELECT src, track, min(t) AS first_t, count(*) AS n FROM r GROUP BY src, track)
      SELECT src, track, CASE WHEN track = 'OFFSCREEN' THEN track ELSE 'T' || (row_number() OVER (PARTITION BY src, track = 'OFFSCREEN' ORDER BY first_t, track))::VARCHAR END AS label, round(first_t, 6) AS first_t, n FROM f""",
)
def speaker_diarization(spark, d):
    """Words in speech, each with the face that goes on speaking; speakers by first appearance."""
    heard = candidates(spark, d, words_in_speech(spark, d))
    said = folds.sticky_speaker(heard, keep=("t",))
    return A.labelled_speakers(said).select("src", "track", "label", F.round("first_t", 6).alias("first_t"), "n")


@query(
    "undo_redo",
    """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'edit' END AS kind, event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      r AS (SELECT doc, n, seq, CASE WHEN kind = 'edit' THEN [value] ELSE [] END AS done, []::BIGINT[] AS undone FROM e WHERE n = 1 UNION ALL
        SELECT e.doc, e.n, e.seq, CASE WHEN kind = 'edit' THEN list_append(r.done, e.value) WHEN kind = 'undo' AND len(r.done) > 0 THEN r.done[:len(r.done) - 1] WHEN kind = 'redo' AND len(r.undone) > 0 THEN list_append(r.done, r.undone[len(r.undone)]) ELSE r.done END,
          CASE WHEN kind = 'edit' THEN [] WHEN kind = 'undo' AND len(r.done) > 0 THEN list_append(r.undone, r.done[len(r.done)]) WHEN kind = 'redo' AND len(r.undone) > 0 THEN r.undone[:len(r.undone) - 1] ELSE r.undone END
        FROM r JOIN e ON e.doc = r.doc AND e.n = r.n + 1)
      SELECT doc, seq, done[len(done)] AS value, len(done)::BIGINT AS undoable, len(undone)::BIGINT AS redoable FROM r""",
)
def undo_redo(spark, d):
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "purchase", "redo").otherwise("edit")
    return blocks.undo_redo(V.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("value")))


@query(
    "caption_chunks",
    """WITH RECURSIVE turns AS (SELECT conv_id AS src, role AS speaker, turn, regexp_split_to_array(trim(text, ' ' || chr(10)), '[ \n]+') AS ws FROM conversations WHERE text IS NOT NULL),
      w AS (SELECT src, speaker, turn, unnest(ws) AS word, unnest(range(0, len(ws))) AS k FROM turns),
      b AS (SELECT src, speaker, word, turn * 100.0::DOUBLE + k * 0.25::DOUBLE AS s, turn * 100.0::DOUBLE + k * 0.25::DOUBLE + 0.2::DOUBLE AS e,
        row_number() OVER (PARTITION BY src ORDER BY turn * 100.0::DOUBLE + k * 0.25::DOUBLE, turn * 100.0::DOUBLE + k * 0.25::DOUBLE + 0.2::DOUBLE, word) AS n FROM w WHERE word <> ''),
      r AS (SELECT src, n, word, s, e, speaker, 1 AS cue, s AS since, 1 AS size, word[-1] IN ('.', '!', '?') AS shut FROM b WHERE n = 1 UNION ALL
        SELECT src, n, word, s, e, speaker, cue + fresh, CASE WHEN fresh = 1 THEN s ELSE since END, CASE WHEN fresh = 1 THEN 1 ELSE size + 1 END, word[-1] IN ('.', '!', '?') FROM
          (SELECT b.*, r.cue, r.since, r.size, (r.shut OR b.e - r.since >= 4 OR r.size >= 12 OR b.s - r.e >= 0.8 OR b.speaker IS DISTINCT FROM r.speaker)::INTEGER AS fresh FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1) x)
      SELECT src, min(s) AS start, max(e) AS "end", string_agg(word, ' ' ORDER BY n) AS text, min(speaker) AS speaker FROM r GROUP BY src, cue""",
)
def caption_chunks(spark, d):
    w = F.posexplode(F.split(F.trim(F.col("text"), F.lit(" \n")), "[ \n]+")).alias("k", "word")
    turns = V.table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("src"), F.col("role").alias("speaker"), "turn", w)
    words = turns.where("word <> ''").withColumn("start", F.col("turn") * 100.0 + F.col("k") * 0.25)
    return folds.caption_chunks(words.withColumn("end", F.col("start") + 0.2))


@query("online_clusters")
def online_clusters(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("src"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return folds.online_clusters(e, threshold=0.3)


@query(
    "moving_average",
    V.ctes("samples") + """, b AS (SELECT src, pos, luma, row_number() OVER (PARTITION BY src ORDER BY t, pos) AS n FROM samples),
      r AS (SELECT src, n, pos, luma AS acc FROM b WHERE n = 1 UNION ALL SELECT b.src, b.n, b.pos, r.acc * 0.8::DOUBLE + b.luma * 0.2::DOUBLE FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1)
      SELECT src, pos, round(acc, 9) AS acc FROM r""",
)
def moving_average(spark, d):
    return blocks.accumulate(V.samples(spark, d), by="src", order=["t", "pos"], key="pos", value="luma", weight=0.2).withColumn("acc", F.round("acc", 9))


EDGES = f"""{NEAR_SQL}, seen AS (SELECT n.word_id, n.src, n.speaker, f.track, (f.w * f.h) * (1 + 0.2 * greatest(0, 1 - sqrt(power(f.x + f.w / 2 - 0.5, 2) + power(f.y + f.h / 2 - 0.5, 2)) / 0.7071)) * (1 + f.mouth) AS score
        FROM near n JOIN faces f USING (pos) WHERE n.speaker IS NOT NULL),
      spread AS (SELECT *, sum(score) OVER (PARTITION BY word_id) AS total, max(score) OVER (PARTITION BY word_id) AS most FROM seen),
      wts AS (SELECT src, speaker, track, sum(most / total * score / total) AS weight FROM spread GROUP BY ALL),
      shr AS (SELECT *, weight / sum(weight) OVER (PARTITION BY src, speaker) AS share, weight / sum(weight) OVER (PARTITION BY src, track) AS whole FROM wts),
      assoc AS (SELECT *, power(share * whole * whole, 1.2) AS a FROM shr), post AS (SELECT src, speaker, track, round(a / sum(a) OVER (PARTITION BY src, speaker), 6) AS posterior FROM assoc),
      b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY posterior DESC, speaker, track) AS n FROM post WHERE posterior >= 0.2)"""


@query(
    "one_to_one_bindings",
    V.ctes("words", "samples", "faces") + ", " + EDGES
    + """, r AS (SELECT src, n, speaker, track, posterior, TRUE AS took, [speaker] AS ss, [track] AS ts FROM b WHERE n = 1 UNION ALL
        SELECT src, n, speaker, track, posterior, took, CASE WHEN took THEN list_append(ss, speaker) ELSE ss END, CASE WHEN took THEN list_append(ts, track) ELSE ts END FROM
          (SELECT b.*, r.ss, r.ts, NOT list_contains(r.ss, b.speaker) AND NOT list_contains(r.ts, b.track) AS took FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1) x)
      SELECT src, speaker, track, posterior FROM r WHERE took""",
)
def one_to_one_bindings(spark, d):
    edges = A.posteriors(A.binding_weights(V.words(spark, d), V.samples(spark, d), V.faces(spark, d)))
    return folds.one_to_one(edges.withColumn("posterior", F.round("posterior", 6)), least=0.2)


@query(
    "normalised_cues",
    V.ctes("samples") + """, b AS (SELECT src, t AS s, t + luma * 20 AS e, pos::VARCHAR AS text, row_number() OVER (PARTITION BY src ORDER BY t, t + luma * 20) AS n FROM samples WHERE t >= 0),
      r AS (SELECT src, n, s, e, text, e > s AS ok, CASE WHEN e > s THEN e ELSE 0 END AS reach FROM b WHERE n = 1 UNION ALL
        SELECT src, n, greatest(s, reach), e, text, e > greatest(s, reach), CASE WHEN e > greatest(s, reach) THEN e ELSE reach END FROM (SELECT b.*, r.reach FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1) x)
      SELECT src, round(s, 6) AS start_t, round(e, 6) AS end_t, text FROM r WHERE ok""",
)
def normalised_cues(spark, d):
    cues = V.samples(spark, d).select("src", F.col("t").alias("start"), (F.col("t") + F.col("luma") * 20).alias("end"), F.col("pos").cast("string").alias("text"), F.lit(None).cast("string").alias("speaker"))
    return folds.normalise_cues(cues).select("src", F.round("start", 6).alias("start_t"), F.round("end", 6).alias("end_t"), "text")


_POLES = list(zip(blocks.PINK_POLES, blocks.PINK_GAINS))
_FILTER = ", ".join(f"x.b{k} * {p}::DOUBLE + {g}::DOUBLE * x.w AS b{k}" for k, (p, g) in enumerate(_POLES))


@query(
    "pink_noise",
    V.ctes("samples") + f""", b AS (SELECT src, pos, skin * 2 - 1 AS w, row_number() OVER (PARTITION BY src ORDER BY pos) AS n FROM samples),
      r AS (SELECT src, n, pos, w, {', '.join(f'{g}::DOUBLE * w AS b{k}' for k, (_, g) in enumerate(_POLES))}, 0::DOUBLE AS held, w * 0.115926::DOUBLE AS b6 FROM b WHERE n = 1 UNION ALL
        SELECT x.src, x.n, x.pos, x.w, {_FILTER}, x.b6, x.w * 0.115926::DOUBLE FROM (SELECT b.src, b.n, b.pos, b.w, {', '.join(f'r.b{k}' for k in range(7))} FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1) x)
      SELECT src, pos AS i, round((b0 + b1 + b2 + b3 + b4 + b5 + held + w * 0.5362::DOUBLE) * 0.11::DOUBLE, 9) AS value FROM r""",
)
def pink_noise(spark, d):
    white = V.samples(spark, d).select("src", F.col("pos").alias("i"), (F.col("skin") * 2 - 1).alias("value"))
    return blocks.pink_noise(white).withColumn("value", F.round("value", 9))


_FRAMES = """WITH RECURSIVE b AS (SELECT label AS src, vec_id AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n,
        list_concat(list_concat(list_transform(embedding, lambda v: least(1, greatest(0, 0.5::DOUBLE + v::DOUBLE * 2))), list_transform(embedding, lambda v: least(1, greatest(0, 0.45::DOUBLE + v::DOUBLE)))),
                    list_transform(embedding, lambda v: least(1, greatest(0, 0.4::DOUBLE - v::DOUBLE)))) AS f FROM embeddings WHERE label IS NOT NULL),
      r AS (SELECT src, n, frame, f AS acc FROM b WHERE n = 1 UNION ALL
        SELECT b.src, b.n, b.frame, list_transform(list_zip(r.acc, b.f), lambda z: z[1] * 0.85::DOUBLE + z[2] * 0.15::DOUBLE) FROM r JOIN b ON b.src = r.src AND b.n = r.n + 1)"""
_AT = ", ".join(f"round(acc[i + {64 * k + 1}], 9) AS {c}" for k, c in enumerate("rgb"))


def accumulated_frames(spark, d):
    """Every source's frames as red, green and blue in one array, averaged over the frames before."""
    frames = V.frames(spark, d, "label").where("label is not null").select("frame", F.col("label").cast("long").alias("src"), F.concat("r", "g", "b").alias("f"))
    return blocks.accumulate(frames, by="src", order=["frame"], key="frame", value="f", weight=0.15)


def _to_pixels(frames, *names):
    i = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    at = frames.select(*names, "acc", i)
    return at.select(*names, (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *[F.round(F.get("acc", F.col("i") + 64 * k), 9).alias(c) for k, c in enumerate("rgb")])


@query("px_accumulate", _FRAMES + f" SELECT src, frame, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, {_AT} FROM r, (SELECT unnest(range(64)) AS i)")
def px_accumulate(spark, d):
    """The temporal accumulator after each frame of a source."""
    return _to_pixels(accumulated_frames(spark, d), "src", "frame")


@query("px_resolve", _FRAMES + f" SELECT src, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, {_AT} FROM r, (SELECT unnest(range(64)) AS i) WHERE (src, n) IN (SELECT src, max(n) FROM r GROUP BY src)")
def px_resolve(spark, d):
    """What a source's accumulator holds in the end."""
    last = accumulated_frames(spark, d).groupBy("src").agg(F.max_by("acc", "frame").alias("acc"))
    return _to_pixels(last, "src")
