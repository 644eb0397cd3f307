"""Views of the test tables that the registered queries start from, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.config import BASE_HASH, MULTIPLIER
from strandframe.functions.sequences import CIGAR_TYPE, read_name, reference_name
from strandframe.runtime import table


def references(spark, d) -> DataFrame:
    """``ref_id, ref_name, seq`` of every reference."""
    return table(spark, d, "ref_seqs").select("ref_id", reference_name(F.col("ref_name"), F.col("ref_id")).alias("ref_name"), F.col("ref_seq").alias("seq"))


def reads(spark, d) -> DataFrame:
    """Reads by id, of redelivered ones the last."""
    rows = table(spark, d, "read_batch").select("read_id", "batch_id", read_name(F.col("read_name")).alias("name"), "seq1", "qual1", "seq2", "qual2", "loaded_at")
    last = Window.partitionBy("read_id").orderBy(F.desc("loaded_at"), F.desc("batch_id"))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "loaded_at")


def planted(spark, d) -> DataFrame:
    """Alignments by arithmetic on the reads, to check what follows alignment against SQL."""
    sides = F.explode(F.expr("transform(flatten(array(array((1, 1), (1, 2)), array((2, 1), (2, 2)))), x -> struct(x.col1 as mate, x.col2 as rank))"))
    rows = reads(spark, d).select("read_id", F.length("seq1").alias("l1"), F.length("seq2").alias("l2"), sides.alias("x")).select(
        "read_id", "x.mate", "x.rank", F.expr("if(x.mate = 1, l1, l2)").alias("len")
    )
    r, m, k = "read_id", "mate", "rank"
    rows = rows.filter(f"len > 0 and ({r} + 3 * {m} + 5 * {k}) % 7 <> 0")
    op = lambda n, letter: f"named_struct('len', cast({n} as int), 'op', '{letter}')"
    ops = ", ".join([op(f"{r} % 4", "S"), op(f"greatest(1, len - {r} % 4 - {m})", "M"), op(m, "I"), op(f"{r} % 5", "D")])
    cigar = f"cast(filter(array({ops}), x -> x.len > 0) as {CIGAR_TYPE})"
    return rows.selectExpr(
        r, m, k, f"cast(1 + ({r} * 7 + ({k} - 1) * {m}) % 40 as bigint) ref_id", f"cast(({r} * 7919 + {m} * 131 + {k} * 57) % 3000 as int) pos",
        f"({r} + {m} + {k}) % 2 = 1 is_rev", f"cast(({r} * 5 + {k}) % 61 as int) mapq", f"{cigar} cigar",
        f"cast(({r} + {m}) % 9 as int) nm", f"cast(2 * len - ({r} * 31 + {m} * 17 + {k} * 13) % 50 as int) as_score",
    )


def planted_sam(spark, d) -> DataFrame:
    """SAM-like rows of two tools whose names carry the truth, by arithmetic on the reads."""
    r = table(spark, d, "read_batch").select("read_id").distinct()
    rows = r.select("read_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("m"))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("e")).filter("e = 0 or read_id % 29 = 0")
    rows = rows.selectExpr("*", "1 + (read_id * 7) % 40 ref", "(read_id * 7919) % 3000 + 1 p")
    return rows.selectExpr(
        "if(t = 0, 'a', 'b') tool",
        "concat('ref_', ref, '_', p + 131, '_', p + 262, '_0_1_', read_id, '/', m) qname",
        "cast(if(m = 1, 65, 129) + if((read_id + 2 * m + t) % 19 = 0, 4, 0) + if((read_id + t) % 23 = 0, 256, 0) as int) flag",
        "concat('ref_', if((read_id + m + t) % 17 = 0, ref + 1, ref)) rname",
        "cast(p + 131 * m + 3 * e + case (read_id * 13 + m + t) % 11 when 0 then 500 when 1 then 11 when 2 then 10 when 3 then -7 when 4 then 29 else 0 end as bigint) pos",
        "cast((read_id * 5 + m + t) % 61 as int) mapq",
        "(read_id * 2 + m) * 2 + e row_no",
    )


# --- the same in SQL -----------------------------------------------------------

REFS = r"""refs as (select ref_id, coalesce(nullif(regexp_extract(trim(ref_name, E' \t\n\r'), '^\S*'), ''), 'ref_' || ref_id) ref_name, ref_seq seq from ref_seqs)"""
READS = r"""reads as (select read_id, batch_id, regexp_replace(regexp_extract(trim(read_name), '^\S*'), '/[12]$', '') as name, seq1, qual1, seq2, qual2
  from read_batch qualify row_number() over (partition by read_id order by loaded_at desc, batch_id desc) = 1)"""
PLANTED = (
    READS
    + """,
sides as (select read_id, mate, rank, case mate when 1 then length(seq1) else length(seq2) end len
  from reads, (values (1), (2)) x(mate), (values (1), (2)) y(rank)),
planted as (select read_id, mate, rank, 1 + (read_id * 7 + (rank - 1) * mate) % 40 ref_id, (read_id * 7919 + mate * 131 + rank * 57) % 3000 pos,
  (read_id + mate + rank) % 2 = 1 is_rev, (read_id * 5 + rank) % 61 mapq,
  list_filter([{'len': read_id % 4, 'op': 'S'}, {'len': greatest(1, len - read_id % 4 - mate), 'op': 'M'}, {'len': mate, 'op': 'I'},
    {'len': read_id % 5, 'op': 'D'}], lambda x: x.len > 0) cigar,
  (read_id + mate) % 9 nm, 2 * len - (read_id * 31 + mate * 17 + rank * 13) % 50 as_score
  from sides where len > 0 and (read_id + 3 * mate + 5 * rank) % 7 <> 0),
spanned as (select *, pos + cast(list_sum([x.len for x in cigar if x.op in ('M', 'D')]) as bigint) as end_,
  array_to_string([x.len || x.op for x in cigar], '') cigar_text from planted)"""
)
PLANTED_SAM = """sam as (select case t when 0 then 'a' else 'b' end tool,
  'ref_' || ref || '_' || (p + 131) || '_' || (p + 262) || '_0_1_' || read_id || '/' || m qname,
  case m when 1 then 65 else 129 end + case when (read_id + 2 * m + t) % 19 = 0 then 4 else 0 end + case when (read_id + t) % 23 = 0 then 256 else 0 end flag,
  'ref_' || case when (read_id + m + t) % 17 = 0 then ref + 1 else ref end rname,
  p + 131 * m + 3 * e + case (read_id * 13 + m + t) % 11 when 0 then 500 when 1 then 11 when 2 then 10 when 3 then -7 when 4 then 29 else 0 end pos,
  (read_id * 5 + m + t) % 61 mapq, (read_id * 2 + m) * 2 + e row_no
  from (select distinct read_id, 1 + (read_id * 7) % 40 ref, (read_id * 7919) % 3000 + 1 p from read_batch),
    (values (0), (1)) a(t), (values (1), (2)) b(m), (values (0), (1)) c(e) where e = 0 or read_id % 29 = 0)"""

_BASES = ", ".join(f"('{b}', {v}::ubigint)" for b, v in zip("ACGT", BASE_HASH))
ROTATIONS = f"""base as (select * from (values {_BASES}) x(c, x)),
rot as (select c, r, case r when 0 then x else (x >> r) | ((x & ((1::ubigint << r) - 1)) << (64 - r)) end v from base, (select unnest(range(64)) r))"""


def syncmers_sql(name: str, source: str, keys: str) -> str:
    """CTEs that give ``name`` (``keys``, key44, pos) of the sequences of ``source`` (``keys``, seq)."""
    turn = lambda w: f"((p + {w - 1}) % 64)"
    back = lambda x, w: f"case {turn(w)} when 0 then {x} else ({x} >> (64 - {turn(w)})) | (({x} & ((1::ubigint << (64 - {turn(w)})) - 1)) << {turn(w)}) end"
    times = lambda x: f"(({x})::uhugeint * {MULTIPLIER}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    part = f"partition by {keys} order by p rows between"
    return f"""{name}_b as (select {keys}, unnest(range(length(seq))) p, unnest(string_split(upper(seq), '')) c from {source} where length(seq) >= 21),
{name}_v as (select {keys}, p, v, (v is null)::int bad from {name}_b left join rot on rot.c = {name}_b.c and rot.r = p % 64),
{name}_x as (select *, bit_xor(coalesce(v, 0::ubigint)) over ({part} current row and 5 following) x6,
  bit_xor(coalesce(v, 0::ubigint)) over ({part} current row and 20 following) x21,
  sum(bad) over ({part} current row and 20 following) bad21, count(*) over ({part} current row and 20 following) n21 from {name}_v),
{name}_h as (select *, {times(back("x6", 6))} h6, {times(back("x21", 21))} h21 from {name}_x),
{name}_m as (select *, min(h6) over ({part} 1 following and 15 following) rest, lead(h6, 15) over (partition by {keys} order by p) last_h from {name}_h),
{name} as (select {keys}, (h21 >> 20)::bigint key44, p::int pos from {name}_m
  where bad21 = 0 and n21 = 21 and (h6 < rest or (last_h = rest and last_h <= h6)))"""


SEEDS = (
    REFS + ",\n" + ROTATIONS + ",\n" + syncmers_sql("raw", "refs", "ref_id") + """,
rems as (select key44 & 16777215 rem24, count(*) n from raw group by 1),
seeds_i as (select raw.* from raw join rems on key44 & 16777215 = rem24 where n <= 500)"""
)
HITS = (
    SEEDS + ",\n" + READS + r""",
mates as (select read_id, 1 mate, seq1 s from reads where length(seq1) > 0 union all select read_id, 2, seq2 from reads where length(seq2) > 0),
strands as (select read_id, mate, false is_rev, s seq from mates union all
  select read_id, mate, true, regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCATGCA'), '[^ACGT]', 'N', 'g') from mates),
"""
    + syncmers_sql("probe", "strands", "read_id, mate, is_rev")
    + """,
near as (select key44, ref_id, pos, row_number() over (partition by key44 order by ref_id, pos) rank, count(*) over (partition by key44) n from seeds_i),
joined as (select read_id, mate, is_rev, probe.pos qpos, ref_id, near.pos, near.pos - probe.pos diag, n >= 100 as full_
  from probe join near using (key44) where rank <= 100),
hits as (select * from joined qualify row_number() over (partition by read_id, mate order by is_rev, qpos, ref_id, pos) <= 7500)"""
)
VOTES = (
    HITS + """,
votes as (select read_id, mate, ref_id, is_rev, diag, count(*) votes, min(qpos * 4294967296 + pos) first, max(full_::int) full_ from hits group by all),
best as (select read_id, mate, ref_id, is_rev, diag, votes, (first // 4294967296)::int anchor from votes
  qualify row_number() over (partition by read_id, mate, ref_id, is_rev order by votes desc, first) = 1),
total as (select read_id, mate, count(*) hits, max(full_::int) full_ from hits group by all),
groups as (select *, row_number() over w vote_rank, coalesce(lead(votes) over w, 0) runner_up from best
  window w as (partition by read_id, mate order by votes desc, ref_id, is_rev)),
top as (select read_id, mate, vote_rank::int vote_rank, ref_id, is_rev, diag, votes, anchor,
  case vote_rank when 1 then least(round(-10 * log10(greatest(1 / (1 + exp(5 * ((votes - runner_up) / hits - 0.5))), 1e-6))),
    case when full_ = 1 or hits >= 7500 then 30 else 60 end)::int else 0 end mapq
  from groups join total using (read_id, mate) where vote_rank <= 2 and votes >= 2)"""
)
