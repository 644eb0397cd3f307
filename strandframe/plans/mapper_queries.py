"""Registered queries of sequences, index, seeding, votes and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import evaluation as E
from strandframe.operators import index as I
from strandframe.operators.extension import extend_candidates
from strandframe.operators.seeding import best_diagonals, diagonal_votes, probes, seed_hits, top_candidates
from strandframe.operators.syncmers import explode_syncmers
from strandframe.plans import views as V
from strandframe.plans.map_reads import align, map_reads, map_reads_in_passes
from strandframe.plans.simulate import simulated_pairs
from strandframe.runtime import cut


def _seeds(spark, d):
    return I.build_index(V.references(spark, d))


def _hits(spark, d):
    return seed_hits(probes(V.reads(spark, d)), _seeds(spark, d))


def seq_base_code(spark, d):
    """Number of bases of each code in every reference; null counts other letters."""
    letters = V.references(spark, d).select("ref_id", F.explode(F.split("seq", "")).alias("c")).filter("c <> ''")
    return letters.groupBy("ref_id", "c").agg(F.count("*").alias("k")).groupBy("ref_id", S.base_code(F.col("c")).alias("code")).agg(F.sum("k").alias("n"))


def _both_mates(spark, d):
    """``read_id, mate, seq, qual`` of both mates of all reads, missing ones included."""
    sides = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)])
    return V.reads(spark, d).select("read_id", F.inline(sides))


def seq_revcomp(spark, d):
    seq = F.col("seq")
    return _both_mates(spark, d).select("read_id", "mate", S.reverse_complement_upper(seq).alias("for_seeds"), S.reverse_complement(seq).alias("for_output"))


def seq_orient(spark, d):
    seq, qual = S.oriented(F.col("seq"), F.col("qual"), (F.col("read_id") + F.col("mate")) % 2 == 0)
    return _both_mates(spark, d).select("read_id", "mate", seq.alias("seq"), qual.alias("qual"))


def name_normalize(spark, d):
    refs = V.references(spark, d).select(F.lit("ref").alias("kind"), F.col("ref_id").alias("id"), F.col("ref_name").alias("name"))
    return refs.unionByName(V.reads(spark, d).select(F.lit("read").alias("kind"), F.col("read_id").alias("id"), "name"))


def nuclear_references(spark, d):
    return V.references(spark, d).filter(S.is_nuclear(F.col("ref_name"))).select("ref_id", "ref_name")


def read_estimate(spark, d):
    """Reads that the files of raw lines are taken to hold by their size, compressed or not."""
    sizes = spark.read.parquet(f"{d}/raw_reads.parquet").groupBy("file_name").agg(F.coalesce(F.sum(F.octet_length("raw_line") + 1), F.lit(0)).alias("size"))
    return sizes.select("file_name", S.estimated_reads(F.col("size"), F.lit(False)).alias("plain"), S.estimated_reads(F.col("size"), F.lit(True)).alias("gzipped"))


def syncmers(spark, d):
    return explode_syncmers(V.references(spark, d), ["ref_id"], "seq")


def syncmer_density(spark, d):
    n = syncmers(spark, d).groupBy("ref_id").agg(F.count("*").alias("syncmers"))
    refs = V.references(spark, d).filter("length(seq) >= 21").select("ref_id", F.length("seq").alias("bases"))
    return refs.join(n, "ref_id", "left").select("ref_id", "bases", F.coalesce("syncmers", F.lit(0)).alias("syncmers"))


def index_raw_counts(spark, d):
    return I.remainder_counts(explode_syncmers(V.references(spark, d), ["ref_id"], "seq"))


def index_hard_cap(spark, d):
    return _seeds(spark, d)


def index_bucket_offsets(spark, d):
    return I.bucket_offsets(_seeds(spark, d))


def index_stats(spark, d):
    """Seeds kept, distinct keys and size of the references of each index."""
    refs = spark.read.parquet(f"{d}/ref_seqs.parquet").select("index_id", "ref_id", F.coalesce(F.length("ref_seq"), F.lit(0)).alias("n"))
    kept = _seeds(spark, d).groupBy("ref_id").agg(F.count("*").alias("k"))
    return refs.join(kept, "ref_id", "left").groupBy("index_id").agg(
        F.count("*").alias("ref_count"), F.sum("n").alias("genome_size"), F.coalesce(F.sum("k"), F.lit(0)).alias("seeds")
    )


def seed_count_lookup(spark, d):
    """Counts that seed_counts holds, over all indexes, for the keys that stand in seeds."""
    keys = spark.read.parquet(f"{d}/seeds.parquet").filter("key44 >= 0").select("key44").distinct()
    once = spark.read.parquet(f"{d}/seed_counts.parquet").filter("key44 >= 0 and seed_count >= 1").groupBy("index_id", "key44").agg(F.max("seed_count").alias("c"))
    counts = once.groupBy("key44").agg(F.sum("c").alias("seed_count"))
    return keys.join(counts, "key44", "left").select("key44", F.coalesce("seed_count", F.lit(0)).alias("seed_count"))


def seed_join(spark, d):
    return _hits(spark, d).drop("full")


def seed_hits_capped(spark, d):
    hits = _hits(spark, d).groupBy("read_id", "mate").agg(F.count("*").alias("hits"), F.max("full").alias("full"))
    return hits.select("read_id", "mate", "hits", (F.col("full") | (F.col("hits") >= 7500)).alias("capped"))


def diag_votes(spark, d):
    return diagonal_votes(_hits(spark, d)).select("read_id", "mate", "ref_id", "is_rev", "diag", "votes", F.shiftright("first", 32).cast("int").alias("first_qpos"))


def best_diag(spark, d):
    return best_diagonals(diagonal_votes(_hits(spark, d)))


def top2_groups(spark, d):
    return top_candidates(_hits(spark, d))


def align_single(spark, d):
    """All alignments, their CIGAR as text."""
    refs = V.references(spark, d)
    found = extend_candidates(top_candidates(_hits(spark, d)), V.reads(spark, d), refs)
    return found.withColumn("cigar", S.cigar_text(F.col("cigar")))


def _reads(spark, d):
    """The reads, written once: they are needed for probes, extension and SAM rows."""
    return cut(V.reads(spark, d))


def map_paired(spark, d):
    """SAM rows of all reads against all references."""
    return map_reads(_reads(spark, d), _seeds(spark, d), V.references(spark, d))


def map_summary(spark, d):
    """The run's figures: reads, mapped share and coverage of the rows of ``map_paired``."""
    return E.run_summary(map_paired(spark, d), V.references(spark, d))


def map_rate(spark, d):
    """Mapped share of the rows of ``map_paired`` by batch."""
    reads = _reads(spark, d)
    rows = map_reads(reads, _seeds(spark, d), V.references(spark, d)).select("read_id", (~S.flag_set(F.col("flag"), 4)).alias("mapped"))
    return E.mapping_rate(rows.join(reads.select("read_id", "batch_id"), "read_id"), ["batch_id"])


def map_sorted_plain(spark, d):
    """The same without pairing, in the order of places."""
    return map_reads(_reads(spark, d), _seeds(spark, d), V.references(spark, d), pairing="none", style="plain", sort=True)


def map_in_passes(spark, d):
    """SAM rows with the references in passes of a third of their length."""
    refs = V.references(spark, d)
    total = refs.agg(F.sum(F.length("seq"))).first()[0] or 1
    return map_reads_in_passes(_reads(spark, d), refs, -(-total // 3))


def simulated_reads(spark, d):
    return simulated_pairs(V.references(spark, d))


def simulated_accuracy(spark, d):
    """Accuracy of reads that are cut from the references with planted origins and substitutions."""
    refs = V.references(spark, d)
    refs = refs.withColumn("ref_name", F.concat(F.lit("ref"), F.col("ref_id").cast("string")))
    rows = map_reads(simulated_pairs(refs), _seeds(spark, d), refs).withColumn("tool", F.lit("strandframe")).withColumn("row_no", F.col("read_id"))
    return E.accuracy(E.judged(E.truth_from_names(rows), E.tool_results(rows)))


QUERIES = {
    f.__name__: f
    for f in (
        seq_base_code, seq_revcomp, seq_orient, name_normalize, nuclear_references, read_estimate, syncmers, syncmer_density, index_raw_counts, index_hard_cap,
        index_bucket_offsets, index_stats, seed_count_lookup, seed_join, seed_hits_capped, diag_votes, best_diag, top2_groups, align_single, map_paired, map_summary, map_rate,
        map_sorted_plain, map_in_passes, simulated_reads, simulated_accuracy,
    )
}

_BOTH = "two as (select read_id, 1 mate, seq1 s, qual1 q from reads union all select read_id, 2, seq2, qual2 from reads)"

SQL = {
    "seq_base_code": f"""with {V.REFS}, l as (select ref_id, upper(unnest(string_split(seq, ''))) c from refs where length(seq) > 0)
        select ref_id, nullif(instr('ACGT', c) - 1, -1)::int code, count(*) n from l group by 1, 2""",
    "seq_revcomp": f"""with {V.READS}, {_BOTH} select read_id, mate,
        regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCATGCA'), '[^ACGT]', 'N', 'g') for_seeds,
        regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCAtgca'), '[^ACGTacgt]', 'N', 'g') for_output from two""",
    "seq_orient": f"""with {V.READS}, {_BOTH} select read_id, mate,
        case (read_id + mate) % 2 when 0 then regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCAtgca'), '[^ACGTacgt]', 'N', 'g') else s end seq,
        case (read_id + mate) % 2 when 0 then reverse(q) else q end qual from two""",
    "name_normalize": f"with {V.REFS}, {V.READS} select 'ref' kind, ref_id id, ref_name as name from refs union all select 'read', read_id, name from reads",
    "nuclear_references": f"""with {V.REFS} select ref_id, ref_name from refs where not (
        list_has_any(regexp_extract_all(lower(ref_name), '[a-z]+'), ['ct', 'pt', 'mt']) or lower(ref_name) like '%scaffold%' or lower(ref_name) like '%contig%')""",
    "read_estimate": """with s as (select file_name, coalesce(sum(strlen(raw_line) + 1), 0) size from raw_reads group by 1)
        select file_name, floor(size / 400)::bigint plain, floor(size * 3.5 / 400)::bigint gzipped from s""",
    "syncmers": f"with {V.REFS}, {V.ROTATIONS}, {V.syncmers_sql('raw', 'refs', 'ref_id')} select * from raw",
    "syncmer_density": f"""with {V.REFS}, {V.ROTATIONS}, {V.syncmers_sql("raw", "refs", "ref_id")}
        select ref_id, length(seq)::int bases, (select count(*) from raw where raw.ref_id = refs.ref_id) syncmers from refs where length(seq) >= 21""",
    "index_raw_counts": f"with {V.SEEDS} select rem24, n from rems",
    "index_hard_cap": f"with {V.SEEDS} select key44, ref_id, pos from seeds_i",
    "index_bucket_offsets": f"""with {V.SEEDS}, b as (select key44 >> 24 bucket, count(*) n from seeds_i group by 1)
        select bucket, n, coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0)::bigint as first from b""",
    "index_stats": f"""with {V.SEEDS}, k as (select ref_id, count(*) k from seeds_i group by 1)
        select index_id, count(*) ref_count, sum(coalesce(length(ref_seq), 0))::bigint genome_size, coalesce(sum(k), 0)::bigint seeds
        from ref_seqs left join k using (ref_id) group by 1""",
    "seed_count_lookup": """with o as (select index_id, key44, max(seed_count) c from seed_counts where key44 >= 0 and seed_count >= 1 group by 1, 2),
        c as (select key44, sum(c)::bigint n from o group by 1)
        select key44, coalesce(n, 0) seed_count from (select distinct key44 from seeds where key44 >= 0) left join c using (key44)""",
    "seed_join": f"with {V.HITS} select read_id, mate, is_rev, qpos, ref_id, pos, diag from hits",
    "seed_hits_capped": f"with {V.HITS} select read_id, mate, count(*) hits, bool_or(full_) or count(*) >= 7500 as capped from hits group by all",
    "diag_votes": f"with {V.VOTES} select read_id, mate, ref_id, is_rev, diag, votes, (first // 4294967296)::int first_qpos from votes",
    "best_diag": f"with {V.VOTES} select * from best",
    "top2_groups": f"with {V.VOTES} select * from top",
}
