"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm.heavy_hitters import heavy_hitters
from strandframe.llm.packing import pack_items
from strandframe.llm.shared_spans import shared_spans
from strandframe.llm.splitting import split_oversized
from strandframe.llm.subjects import assign_subjects
from strandframe.llm.term_stats import marked, term_statistics
from strandframe.llm.tokenizer import token_count, token_ids
from strandframe.runtime import cut, table

# --- problem 1: shared spans -------------------------------------------------


def p1_found(spark, d):
    return shared_spans(table(spark, d, "ref_seqs"), "ref_id", "ref_seq", 64)


def p1_shared(spark, d):
    """Number of shared bases of each record that has any."""
    length = F.col("span_end") - F.col("span_start")
    return p1_found(spark, d).groupBy("ref_id").agg(F.count("*").alias("spans"), F.sum(length).alias("shared_bases"))


_P1 = """
with t as (select ref_id, upper(ref_seq) s from ref_seqs where length(ref_seq) >= 64),
i as (select ref_id, s, unnest(range(length(s) - 63)) a from t),
w as (select ref_id, a, s[a + 1 : a + 64] k from i),
v as (select * from w where regexp_full_match(k, '[ACGT]{64}')),
c as (select k from v group by k having min(ref_id) < max(ref_id)),
h as (select ref_id, a, a - row_number() over (partition by ref_id order by a) g from v semi join c using (k)),
r as (select ref_id, min(a) s, max(a) + 64 e from h group by ref_id, g),
n as (select *, case when s > coalesce(max(e) over (partition by ref_id order by s rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end f from r),
m as (select *, sum(f) over (partition by ref_id order by s) run from n),
o as (select ref_id, min(s) span_start, max(e) span_end from m group by ref_id, run)
"""

# --- problem 2: splitting -------------------------------------------------


def _latest_reads(spark, d):
    """One row per read: the delivery loaded last."""
    long = table(spark, d, "read_batch").filter(F.length("seq1") > 500)
    return long.groupBy("read_id").agg(F.max_by("seq1", F.struct("loaded_at", "seq1")).alias("seq1"))


def _split(spark, d):
    refs = table(spark, d, "ref_seqs").filter(F.length("ref_seq") > 4000)
    a = split_oversized(refs, "ref_seq", 4000, 150, keep=["ref_id"])
    b = split_oversized(_latest_reads(spark, d), "seq1", 500, 30, keep=["read_id"])
    return a.select(F.lit("ref").alias("item_kind"), F.col("ref_id").alias("item_id"), "cut", "pieces").unionByName(
        b.select(F.lit("read").alias("item_kind"), F.col("read_id").alias("item_id"), "cut", "pieces")
    )


def p2_found(spark, d):
    return _split(spark, d).filter(F.col("cut").isNotNull()).select("item_kind", "item_id", "cut")


def p2_pieces(spark, d):
    """Every piece of every oversized item, in order."""
    rows = _split(spark, d).select("item_kind", "item_id", F.posexplode("pieces").alias("piece_no", "p"))
    return rows.select("item_kind", "item_id", "piece_no", F.col("p.start").alias("piece_start"), F.col("p.end").alias("piece_end"), F.col("p.piece").alias("piece"))


P2_SQL = """
with items as (
  select 'ref' item_kind, ref_id item_id, ref_seq seq, 3850 step from ref_seqs where length(ref_seq) > 4000
  union all
  select distinct 'read', read_id, seq1, 470 from read_batch where length(seq1) > 500),
s as (select item_kind, item_id, step, string_split_regex(seq, '[Nn]{10,}') parts from items)
select item_kind, item_id, case when list_max([length(x) for x in parts]) <= step then 'natural' else 'forced' end as cut from s
"""

# --- problem 3: most frequent keys ------------------------------------------


def _counts_once(spark, d):
    """Valid rows of seed_counts, a redelivered (index, key) once."""
    rows = table(spark, d, "seed_counts").filter((F.col("key44") >= 0) & (F.col("seed_count") >= 1))
    return cut(rows.groupBy("index_id", "key44").agg(F.max("seed_count").alias("seed_count")))  # read several times


def p3_found(spark, d):
    return p3_frequent(spark, d).select("origin", "key44")


def p3_frequent(spark, d):
    """Frequent keys with their counts."""
    seeds = table(spark, d, "seeds")
    a = heavy_hitters(seeds, "key44", 0.001, total=seeds.count())
    b = heavy_hitters(_counts_once(spark, d), "key44", 0.005, weight="seed_count")
    return a.select(F.lit("seeds").alias("origin"), F.col("value").alias("key44"), "weight").unionByName(
        b.select(F.lit("seed_counts").alias("origin"), F.col("value").alias("key44"), "weight")
    )


_P3 = """
with once as (select index_id, key44, max(seed_count) c from seed_counts where key44 >= 0 and seed_count >= 1 group by all),
a as (select 'seeds' origin, key44, count(*) weight from seeds where key44 >= 0 group by all having count(*) >= (select count(*) from seeds) / 1000.0),
b as (select 'seed_counts' origin, key44, cast(sum(c) as bigint) weight from once group by all having sum(c) >= (select sum(c) from once) / 200.0)
"""

# --- problem 4: frequency of every key --------------------------------------


def p4_terms(spark, d):
    """Occurrences, records and mark of every key."""
    a = marked(term_statistics(table(spark, d, "seeds"), "key44", "ref_id", place="ref_pos"), 100)
    b = marked(term_statistics(table(spark, d, "seed_counts"), "key44", "index_id", weight="seed_count"), 500)
    both = a.withColumn("origin", F.lit("seeds")).unionByName(b.withColumn("origin", F.lit("seed_counts")))
    return both.select("origin", F.col("term").alias("key44"), "occurrences", "records", "mark")


def p4_found(spark, d):
    return p4_terms(spark, d).filter(F.col("mark").isNotNull()).select("origin", "key44", "mark")


_P4 = """
with s as (select key44, count(*) occurrences, count(distinct coalesce(ref_id, -9223372036854775808)) records from
  (select distinct key44, ref_id, ref_pos from seeds where key44 >= 0) group by 1),
o as (select index_id, key44, max(seed_count) c from seed_counts where key44 >= 0 and seed_count >= 1 group by 1, 2),
c as (select key44, cast(sum(c) as bigint) occurrences, count(*) records from o group by 1),
u as (select 'seeds' origin, *, 100 above from s union all select 'seed_counts', *, 500 from c),
m as (select origin, key44, occurrences, records, case when occurrences > above then 'common' when records = 1 then 'rare' end mark from u)
"""

# --- problem 6: token ids ----------------------------------------------------


def p6_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", token_ids(spark, "text").alias("ids"))


# --- problem 7: containers of 2,048 tokens -----------------------------------

CAPACITY = 2048


def p7_packed(spark, d):
    """Container and place of every text with a token (of every piece, where the text exceeds a container)."""
    sizes = table(spark, d, "documents").select("doc_id", token_count(spark, "text").alias("tokens"))
    placed = pack_items(sizes, "doc_id", "tokens", CAPACITY)
    return placed.select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), F.col("container").alias("container_id"), "start", "by_pattern")


def p7_containers(spark, d):
    """Texts and tokens of every container, those of them that a pattern placed, and the space left."""
    by_pattern = F.coalesce(F.sum(F.when(F.col("by_pattern"), F.col("tokens"))), F.lit(0))
    used = p7_packed(spark, d).groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), by_pattern.alias("pattern_tokens"))
    return used.withColumn("space_left", CAPACITY - F.col("tokens"))


# --- problem 8: subjects -------------------------------------------------------


def p8_found(spark, d):
    return assign_subjects(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_examples"), "text", "subject")


def p8_composition(spark, d):
    """Documents of each subject area, those without a document included."""
    areas = table(spark, d, "subject_areas").select("subject").distinct()
    counts = p8_found(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    return areas.join(counts, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_shared": p1_shared,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_frequent": p3_frequent,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
SQL = {
    "p1_found": _P1 + "select ref_id, span_start, span_end from o",
    "p1_shared": _P1 + "select ref_id, count(*) spans, cast(sum(span_end - span_start) as bigint) shared_bases from o group by 1",
    "p2_found": P2_SQL,
    "p3_found": _P3 + "select origin, key44 from a union all select origin, key44 from b",
    "p3_frequent": _P3 + "select * from a union all select * from b",
    "p4_found": _P4 + "select origin, key44, mark from m where mark is not null",
    "p4_terms": _P4 + "select * from m",
}
