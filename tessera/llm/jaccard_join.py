"""N-gram Jaccard join by adaptive multi-match prefixes.

A first pass over whole texts drops documents that can't have a partner: in the order of the shingles' hashes it
lengthens each prefix by an eighth of the set, of which a partner would have to share as many. Shingles of these prefixes that only
one text has are counted away; a document that keeps too few is linked with nothing. The
sets of the others meet on prefixes of their rarest shingles, see ``prefix_join``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import merge_components
from tessera.llm.prefix_join import least_overlap, linked, links_across, prefix_keys, with_hubs
from tessera.llm.shared import discard, materialise, table
from tessera.llm.shingles import bodies, in_chunks, shingle_sets

PERCENT, SHINGLE = 80, 5
# A set of n shingles asks for 1 + n // SHARE common ones in the first pass.
SHARE = 8


def _prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many shingles of n are looked at, and how many of them any partner has; a partner asks for as many as its own size says."""
    partner = -(-percent * n // 100)
    return min(n, n - least_overlap(n, partner, percent) + 1 + n // SHARE), min(1 + partner // SHARE, n)


def _sketch(percent: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, chunk in in_chunks(bodies(batch.column("body"))):
                sizes, needed, digests, prefixes = [], [], [], []
                for s in shingle_sets(chunk, shingle):
                    length, matches = _prefix_sizes(len(s), percent) if len(s) else (0, 0)
                    sizes.append(len(s))
                    needed.append(matches)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    prefixes.append(s[:length].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes)))
                own = batch.slice(at, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(chunk))), own.column("doc_id"), own.column("uid"), pa.array(sizes, pa.int64()), pa.array(needed, pa.int64()), pa.array(digests, pa.binary()), lists],
                    names=["row", "doc_id", "uid", "n_shingles", "needed", "digest", "prefix"],
                )
                row += len(chunk)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in in_chunks(bodies(batch.column("body"))):
                sets = [s.tobytes() for s in shingle_sets(chunk, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(chunk)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _with_partners(sketches: DataFrame) -> DataFrame:
    """Rows of the sketches that share enough of their prefix with other texts for there to be a link."""
    prefixes = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("row", "needed", F.xxhash64("digest").alias("text"), F.explode("prefix").alias("token"))
    # copies are one text; rows are summed up before they are dealt out
    shared = materialise(prefixes.groupBy("token").agg(F.min("text").alias("one"), F.max("text").alias("other")).where("one <> other").select("token"), "shared")
    found = prefixes.select("row", "needed", "token").join(shared, "token", "left_semi").groupBy("row", "needed").agg(F.count("*").alias("found"))
    out = materialise(found.where("found >= needed").select("row"), "with_partners")
    discard(shared)
    return out


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles of
    ``shingle`` words, or with fewer words all of them as one. Documents are linked if 100 * intersection >= percent * union;
    component_id is the smallest identifier that links reach. Links inside a component need not all be looked at; no component is split for it.

    Nulls: a null or wordless text has no shingles, is linked to nothing and is its own component; a null identifier has a null
    component_id and links nothing. Rows that repeat an identifier each get the component of their own text. An empty table gives
    an empty result. Texts may be of any length.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body")).withColumn("uid", F.xxhash64("body"))
    kinds = "row long, doc_id long, uid long, n_shingles long, needed long, digest binary, prefix array<long>"
    sketches = materialise(named.mapInArrow(_sketch(percent, shingle), kinds), "sketches")
    partnered = _with_partners(sketches)
    told = materialise(sketches.select("row", "doc_id", "uid", "n_shingles", "digest"), "told")
    discard(sketches)
    # all rows of a text with partners have them, and a text is one node
    some = told.join(partnered, "row", "left_semi").groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("one"))
    in_order = some.repartitionByRange("one", "digest").sortWithinPartitions("one", "digest")
    nodes = materialise(in_order.select(F.monotonically_increasing_id().alias("node"), "one.doc_id", "one.uid", "digest"), "nodes")
    wanted = named.join(nodes.select("node", "doc_id", "uid").hint("merge"), ["doc_id", "uid"]).groupBy("node").agg(F.first("body").alias("body"))
    sets = materialise(wanted.select("node", "body").mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")

    keys = prefix_keys(sets, percent)
    compared = with_hubs(keys, sets)
    labels = merge_components(nodes.select("node", F.col("node").alias("label")), linked(compared, percent))
    labels = merge_components(labels, links_across(keys, compared, labels, sets, percent))

    reached = labels.join(nodes.select(F.col("node").alias("label"), F.col("doc_id").alias("component_id")), "label")
    by_digest = materialise(nodes.join(reached, "node").select("digest", "component_id"), "by_digest")
    # texts without partners are still one component with their copies
    alone = told.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("smallest"))
    of_text = materialise(alone.join(by_digest, "digest", "left").select("digest", F.coalesce("component_id", "smallest").alias("component_id")), "of_text")
    discard(partnered, nodes, sets, keys, compared, labels, by_digest)
    placed = told.join(of_text, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return placed.select("doc_id", "n_shingles", component)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
