"""MinHash near-duplicate detection by tensored banding.

Two collections of small minhash keys are computed for each document. A table is a pair (i, j) of
them, its key the i-th of the first with the j-th of the second: TABLES**2 tables need only
2 * TABLES * ROWS minhashes. Documents that share a table key are candidates; links are
confirmed on whole shingle sets.

At a similarity of 0.75 a link is missed by all tables with a probability of about 4e-5
(2 * (1 - 0.75**3)**20); components join most of those by other links. No candidate is
dropped on a sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components, merge_components
from tessera.llm.prefix_join import linked, links_across, overlaps, prefix_keys, with_hubs
from tessera.llm.shared import discard, materialise, table
from tessera.llm.shingles import bodies, finish, in_chunks, shingle_sets

TABLES, ROWS, SHINGLE = 20, 3, 5
_HASHES = 2 * TABLES * ROWS
_FACTORS = np.random.default_rng(8).integers(1, 2**63, _HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
PERCENT = 75


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of non-empty sets: a row for each, a column for each hash."""
    out = np.empty((len(sets), _HASHES), np.uint64)
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for n, factor in enumerate(_FACTORS):
        out[:, n] = np.minimum.reduceat(joined * factor, starts)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        for at, chunk in in_chunks(bodies(batch.column("body"))):
            sets = list(shingle_sets(chunk, SHINGLE))
            full = [s for s in sets if len(s)]
            if full:
                mins = finish(_signatures(full))
                keys = mins[:, 0::ROWS].copy()
                for r in range(1, ROWS):
                    keys = finish(keys * np.uint64(3) + mins[:, r::ROWS])
                keys = keys.view(np.int64)
            rows, n = [], 0
            for s in sets:
                if len(s):
                    rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys[n, :TABLES].tolist(), keys[n, TABLES:].tolist()))
                    n += 1
                else:
                    rows.append((None, None, None))
            digest, first, second = zip(*rows)
            own = batch.slice(at, len(chunk))
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("uid"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(first, longs), pa.array(second, longs)],
                names=["doc_id", "uid", "n_shingles", "digest", "first", "second"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, chunk in in_chunks(bodies(batch.column("body"))):
            sets = [s.tobytes() for s in shingle_sets(chunk, SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(chunk)), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _shared_keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, hub) for every table key that at least two nodes share, hub being its smallest node; and
    rows (node, i, part) for every key of the first collection that at least two share."""
    first = nodes.select("node", F.posexplode("first").alias("i", "part"))
    many = materialise(first.groupBy("i", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "many")
    # a key of the second collection can only be shared where the first one is
    halves = materialise(first.join(many, ["i", "part"], "left_semi"), "halves")
    both = halves.join(nodes.select("node", "second"), "node").select("node", "i", "part", F.posexplode("second").alias("j", "other"))
    keyed = materialise(both.select(F.xxhash64("i", "j", "part", "other").alias("key"), "node"), "keys")
    smallest = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n"), "smallest")
    members = materialise(keyed.join(smallest, "key"), "members")
    discard(many, keyed, smallest)
    return members, halves


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows (i, part, largest): keys of the first collection whose nodes have several labels, with the most frequent one."""
    sizes = labelled.groupBy("i", "part", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("i", "part").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("apart"))
    return materialise(largest.where("apart > 1").drop("apart"), "mixed_keys")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", details: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set holds its
    distinct five-word shingles, or with fewer words all of them as one. Documents are linked if
    100 * intersection >= 75 * union; component_id is the smallest identifier that links reach.

    Equal sets are one node from the start. All nodes of a key are compared to one representative, which
    costs one comparison for each member. Nodes of keys that still hold several components meet on prefixes of their shingles, rarest first, as
    long as their sizes require (see ``prefix_join``), so a group of texts that are all under the threshold makes no pairs of what each has alone.

    Nulls: a null or wordless text has no shingles, is linked to nothing and is its own component;
    a null identifier has a null component_id and is kept. Rows that repeat an identifier each get
    the component of their own text. An empty table gives an empty result. Texts may be of any length.

    With ``details`` there are also ``uid``, the xxhash64 of the text's bytes, and ``component``, a number that no other
    component has, null for rows that are linked to nothing.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body")).withColumn("uid", F.xxhash64("body"))
    sketches = materialise(named.mapInArrow(_sketch, "doc_id long, uid long, n_shingles long, digest binary, first array<long>, second array<long>"), "sketches")
    linkable = sketches.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min(F.struct("doc_id", "uid")).alias("one")
    told = materialise(sketches.select("doc_id", "uid", "n_shingles", "digest"), "told")
    classes = materialise(linkable.groupBy("digest").agg(one, *[F.first(c).alias(c) for c in ("n_shingles", "first", "second")]), "classes")
    # nodes are numbered by their smallest identifier
    in_order = classes.repartitionByRange("one", "digest").sortWithinPartitions("one", "digest")
    nodes = materialise(in_order.select(F.monotonically_increasing_id().alias("node"), "one.doc_id", "one.uid", "digest", "n_shingles", "first", "second"), "nodes")
    discard(sketches, classes)
    members, halves = _shared_keys(nodes)
    involved = materialise(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "uid"), "involved")
    # Those in need of a set grow with the documents, so they are never broadcast; rows that repeat
    # identifier and text give one set.
    wanted = named.join(involved.hint("merge"), ["doc_id", "uid"]).groupBy("doc_id", "uid").agg(F.first("node").alias("node"), F.first("body").alias("body"))
    sets = materialise(wanted.select("node", "body").mapInArrow(_sets, "node long, shingles binary"), "sets")

    # a key's hub is the node that is the smallest one of most tables' keys
    degree = members.groupBy(F.col("hub").alias("node")).agg(F.count("*").alias("n"))
    own = materialise(halves.join(involved.select("node"), "node").join(degree, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))), "own_keys")
    hubs = own.groupBy("i", "part").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("hub"), F.count("*").alias("several")).where("several > 1").drop("several")
    hubs = materialise(hubs, "hubs")
    mixed = materialise(own.drop("n").join(hubs, ["i", "part"]), "mixed")
    pairs = mixed.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    compared = materialise(overlaps(pairs.where("a <> b"), sets), "compared")
    discard(members, halves, own, hubs)
    labels = merge_components(involved.select("node", F.col("node").alias("label")), linked(compared, PERCENT))

    # what is still apart under some key meets on prefixes of its rarest shingles there
    labelled = materialise(mixed.join(labels, "node"), "labelled")
    apart = materialise(labelled.join(_mixed(labelled), ["i", "part"]).select("node").distinct(), "apart")
    some = materialise(sets.join(apart, "node", "left_semi"), "sets_apart")
    keys = prefix_keys(some, PERCENT)
    closer = with_hubs(keys, some)
    labels = merge_components(labels, linked(closer, PERCENT))
    last = merge_components(labels, links_across(keys, closer, labels, some, PERCENT))

    reached = last.join(nodes.select(F.col("node").alias("label"), F.col("doc_id").alias("component_id")), "label")
    of_node = nodes.select("digest", "node", F.col("doc_id").alias("own")).join(reached, "node", "left")
    by_digest = materialise(of_node.select("digest", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("label", "node").alias("component")), "by_digest")
    discard(nodes, involved, sets, mixed, compared, labelled, apart, some, keys, closer, labels, last)
    placed = told.join(by_digest, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    more = ["uid", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")] if details else []
    return placed.select("doc_id", "n_shingles", "component_id", kept, *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
