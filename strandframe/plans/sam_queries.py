"""Registered queries of pairing, SAM rows, passes, evaluation and sets, on planted rows that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import evaluation as E
from strandframe.operators import multipass as M
from strandframe.operators.pairing import first_alignments, pair_candidates, resolve_pairs
from strandframe.operators.sam import coordinate_sorted, sam_header, sam_lines, sam_rows
from strandframe.plans import views as V
from strandframe.plans.views import PLANTED, PLANTED_SAM, REFS
from strandframe.runtime import table

PASS = 3


def cigar_span(spark, d):
    return V.planted(spark, d).select("read_id", "mate", "rank", S.cigar_span(F.col("cigar")).alias("span"))


def cigar_string(spark, d):
    return V.planted(spark, d).select("read_id", "mate", "rank", S.cigar_text(F.col("cigar")).alias("cigar"))


def pair_candidates_(spark, d):
    return pair_candidates(V.planted(spark, d))


def pair_best(spark, d):
    one = lambda m: [F.col(f"r{m}.{c}").alias(f"{c}{m}") for c in ("rank", "ref_id", "pos", "mapq")]
    return resolve_pairs(V.planted(spark, d)).select("read_id", *one(1), *one(2), "proper", "tlen")


def _sam(spark, d, style):
    found = V.planted(spark, d)
    resolved = resolve_pairs(found) if style == "cli" else first_alignments(found)
    return sam_rows(V.reads(spark, d), resolved, V.references(spark, d), style)


def sam_single(spark, d):
    return _sam(spark, d, "cli").filter(~S.flag_set(F.col("flag"), 1)).drop("read_id", "mate", "ref_id")


def sam_paired(spark, d):
    return _sam(spark, d, "cli").filter(S.flag_set(F.col("flag"), 1)).drop("read_id", "mate", "ref_id")


def sam_plain(spark, d):
    return _sam(spark, d, "plain").drop("read_id", "mate", "ref_id")


def sam_text(spark, d):
    return sam_lines(_sam(spark, d, "cli"))


def sam_header_(spark, d):
    return sam_header(V.references(spark, d))


def sam_sorted(spark, d):
    return coordinate_sorted(_sam(spark, d, "cli")).select("read_id", "mate", "ref_id", "pos", "qname")


def run_summary(spark, d):
    return E.run_summary(_sam(spark, d, "cli"), V.references(spark, d))


def mapping_rate(spark, d):
    """Mapped share of the rows of each batch."""
    rows = _sam(spark, d, "cli").select("read_id", (~S.flag_set(F.col("flag"), 4)).alias("mapped"))
    return E.mapping_rate(rows.join(V.reads(spark, d).select("read_id", "batch_id"), "read_id"), ["batch_id"])


def reference_passes(spark, d):
    return M.reference_passes(V.references(spark, d), 100_000)


def _in_passes(spark, d):
    return V.planted(spark, d).withColumn("ref_pass", (F.col("ref_id") % PASS).cast("int"))


def multipass_first(spark, d):
    return M.first_pass_wins(_in_passes(spark, d)).select("read_id", "mate", "rank", "ref_pass")


def multipass_unmapped(spark, d):
    mates = V.reads(spark, d).select("read_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"))
    return M.unmapped(mates, V.planted(spark, d).select("read_id", "mate"))


def multipass_mask(spark, d):
    """Mates of each read that any pass has mapped, as bits."""
    return V.planted(spark, d).groupBy("read_id").agg(F.bit_or("mate").alias("mapped"))


def eval_truth_parse(spark, d):
    return E.truth_from_names(V.planted_sam(spark, d))


def eval_results(spark, d):
    return E.tool_results(V.planted_sam(spark, d))


def _judged(spark, d):
    rows = V.planted_sam(spark, d)
    return E.judged(E.truth_from_names(rows), E.tool_results(rows))


def eval_metrics(spark, d):
    return E.accuracy(_judged(spark, d))


def eval_errors_top20(spark, d):
    return E.first_errors(_judged(spark, d))


def eval_r1(spark, d):
    rows = V.planted_sam(spark, d)
    return E.first_mate_accuracy(E.truth_from_names(rows), rows)


def eval_speedup(spark, d):
    """Letters of each language of a source against those of English, as if languages were tools and letters their time."""
    times = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"))
    return E.with_speed_up(times, "lang", "chars", "en", ["source"])


def sample_scaling(spark, d):
    """Reads of the first n batches."""
    sizes = table(spark, d, "read_batch").groupBy("batch_id").agg(F.count("*").alias("reads"))
    return E.prefix_totals(sizes, "batch_id", "reads", [1, 2, 4, 8, 16, 32, 64, 128, 256, 512])


def not_done(spark, d):
    """References of which no seed has been loaded yet, with their lengths."""
    work = table(spark, d, "ref_seqs").select("ref_id", "index_id", F.length("ref_seq").alias("length"))
    return E.not_done(work, table(spark, d, "seeds").filter("key44 >= 0"), ["ref_id"])


def eval_grid(spark, d):
    """Rows of each experiment: coverage by mutation by language of the documents."""
    grid = E.experiment_grid(spark, tools=("en", "fr", "de", "es"))
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return grid.join(n, F.col("tool") == F.col("lang"), "left").select("coverage", "mutation", "tool", F.coalesce("documents", F.lit(0)).alias("documents"))


def _variants(spark, d):
    key = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").select(key.alias("key"), F.col("l_returnflag").alias("caller"))


def venn3_counts(spark, d):
    return E.set_regions(_variants(spark, d), "key", "caller", ["A", "N", "R"])


def isec_counts(spark, d):
    return E.set_regions(_variants(spark, d).filter("caller <> 'R'"), "key", "caller", ["A", "N"])


def variant_f1(spark, d):
    v = _variants(spark, d)
    return E.variant_accuracy(v.filter("caller = 'N'"), v.filter("caller = 'A'"), "key")


def set_difference(spark, d):
    """Keys of one caller that neither of the others has."""
    v = _variants(spark, d)
    of = lambda c: v.filter(F.col("caller") == c).select("key")
    return of("A").subtract(of("N")).subtract(of("R"))


def set_intersection(spark, d):
    """Keys of two callers that the third lacks."""
    v = _variants(spark, d)
    of = lambda c: v.filter(F.col("caller") == c).select("key")
    return of("A").intersect(of("N")).subtract(of("R"))


def topn_references(spark, d):
    return E.longest_references(V.references(spark, d), 23)


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        cigar_span, cigar_string, pair_candidates_, pair_best, sam_single, sam_paired, sam_plain, sam_text, sam_header_, sam_sorted, run_summary, mapping_rate,
        reference_passes, multipass_first, multipass_unmapped, multipass_mask, eval_truth_parse, eval_results, eval_metrics, eval_errors_top20, eval_r1, eval_speedup,
        sample_scaling, not_done, eval_grid, venn3_counts, isec_counts, variant_f1, set_difference, set_intersection, topn_references,
    )
}

_PAIRS = (
    PLANTED
    + """,
pairs as (select x.read_id, x.rank i, y.rank j, x.as_score + y.as_score score from spanned x join spanned y on x.read_id = y.read_id and x.mate = 1 and y.mate = 2
  and x.ref_id = y.ref_id and x.is_rev <> y.is_rev and greatest(x.end_, y.end_) - least(x.pos, y.pos) < 1000),
best as (select *, score - lead(score) over w lead_, row_number() over w n from pairs window w as (partition by read_id order by score desc, i, j) qualify n = 1),
firsts as (select read_id, min(rank) filter (mate = 1) f1, min(rank) filter (mate = 2) f2 from planted group by 1),
picked as (select f.read_id, coalesce(i, f1) k1, coalesce(j, f2) k2, case when i is null then null when lead_ is null or lead_ > 30 then 60 else 2 * lead_ end pq
  from firsts f left join best using (read_id)),
res as (select p.read_id, coalesce(pq, x.mapq) q1, coalesce(pq, y.mapq) q2, x, y, coalesce(x.ref_id = y.ref_id, false) same,
  greatest(x.end_, y.end_) - least(x.pos, y.pos) size from picked p
  left join spanned x on x.read_id = p.read_id and x.mate = 1 and x.rank = k1 left join spanned y on y.read_id = p.read_id and y.mate = 2 and y.rank = k2),
resolved as (select read_id, q1, q2, x, y, coalesce(same and x.is_rev <> y.is_rev and size < 1000, false) proper,
  case when same then case when x.pos <= y.pos then size else -size end else 0 end tlen from res)"""
)


def _sam_sql(style: str) -> str:
    same = "'='" if style == "cli" else "m.ref_name"
    if style == "cli":
        start = _PAIRS
    else:
        start = PLANTED + """,
firsts as (select read_id, min(rank) filter (mate = 1) f1, min(rank) filter (mate = 2) f2 from planted group by 1),
resolved as (select f.read_id, x.mapq q1, y.mapq q2, x, y, false proper, 0 tlen from firsts f
  left join spanned x on x.read_id = f.read_id and x.mate = 1 and x.rank = f1 left join spanned y on y.read_id = f.read_id and y.mate = 2 and y.rank = f2)"""
    return f"""with {REFS}, {start},
two as (select r.read_id, name, coalesce(length(seq2) > 0, false) paired, 1 mate, coalesce(seq1, '') s, coalesce(qual1, '*') q, x r, y o, q1 mq, proper, tlen t
  from reads r left join resolved using (read_id) where length(seq1) > 0 or length(seq2) > 0
  union all select r.read_id, name, true, 2, coalesce(seq2, ''), coalesce(qual2, '*'), y, x, q2, proper, -tlen
  from reads r left join resolved using (read_id) where length(seq2) > 0),
o as (select two.*, r.read_id is not null has, o.read_id is not null has_o from two),
sam as (select o.read_id, o.mate, case when has then r.ref_id end ref_id, coalesce(name, '*') qname,
  case when not has then 4 else 0 end + case when has and r.is_rev then 16 else 0 end + case when paired then 1 + case when proper and has and has_o then 2 else 0 end
    + case when not has_o then 8 else 0 end + case when has_o and o.is_rev then 32 else 0 end + case o.mate when 1 then 64 else 128 end else 0 end flag,
  coalesce(n.ref_name, '*') rname, coalesce(r.pos + 1, 0) pos, coalesce(mq, 0) mapq, coalesce(r.cigar_text, '*') cigar,
  case when paired and has_o and has and r.ref_id = o.ref_id then {same} when paired and has_o then m.ref_name else '*' end rnext,
  case when paired and has_o then o.pos + 1 else 0 end pnext, {"case when paired then coalesce(t, 0) else 0 end" if style == "cli" else "0"} tlen,
  case when has and r.is_rev then regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCAtgca'), '[^ACGTacgt]', 'N', 'g') else s end seq,
  case when has and r.is_rev then reverse(q) else q end qual, r.nm nm, r.as_score as_score, {"'sf'" if style == "cli" else "null::varchar"} rg
  from o left join refs n on n.ref_id = r.ref_id left join refs m on m.ref_id = o.ref_id)"""


_SAM = _sam_sql("cli")
_JUDGED = f"""with {PLANTED_SAM},
names as (select distinct regexp_extract(qname, '^[^/]*') q from sam),
t as (select q qname, regexp_extract(q, '^(.*?)_(\\d+)_(\\d+)_([01])_([01])_', 1) ref, regexp_extract(q, '^(.*?)_(\\d+)_(\\d+)_([01])_([01])_', 2)::bigint p1,
  regexp_extract(q, '^(.*?)_(\\d+)_(\\d+)_([01])_([01])_', 3)::bigint p2 from names),
truth as (select qname, 1 mate, ref, p1 pos from t union all select qname, 2, ref, p2 from t),
last as (select tool, regexp_extract(qname, '^[^/]*') qname, case when flag & 128 > 0 then 2 else 1 end mate, rname, pos, flag, mapq from sam where flag & 2304 = 0
  qualify row_number() over (partition by tool, regexp_extract(qname, '^[^/]*'), flag & 128 order by row_no desc) = 1),
results as (select tool, qname, mate, case when flag & 4 = 0 and mapq > 0 then rname end rname, case when flag & 4 = 0 and mapq > 0 then pos end pos from last),
judged as (select tool, truth.qname, truth.mate, ref, truth.pos, rname, r.pos found,
  case when rname is null then 'FN' when rname = ref and abs(r.pos - truth.pos) <= 10 then 'TP' else 'FP' end verdict
  from truth cross join (select distinct tool from results) left join results r using (tool, qname, mate))"""


def _scores(tp: str, fp: str, positives: str) -> str:
    p, r = f"case when {tp} + {fp} > 0 then {tp} / ({tp} + {fp}) else 0 end", f"case when {positives} > 0 then {tp} / {positives} else 0 end"
    return f"100 * ({p}) as precision, 100 * ({r}) as recall, case when ({p}) + ({r}) > 0 then 100 * ((2 * ({p}) * ({r})) / (({p}) + ({r}))) else 0 end as f1"


_VARIANTS = """with v as (select l_partkey || ':' || l_suppkey as key, l_returnflag caller from lineitem),
k as (select key, bool_or(caller = 'A') a, bool_or(caller = 'N') n, bool_or(caller = 'R') r from v group by 1)"""

SQL = {
    "cigar_span": f"with {PLANTED} select read_id, mate, rank, (end_ - pos)::int span from spanned",
    "cigar_string": f"with {PLANTED} select read_id, mate, rank, cigar_text cigar from spanned",
    "pair_candidates": f"with {_PAIRS} select read_id, i, j, score from pairs",
    "pair_best": f"""with {_PAIRS} select read_id, x.rank rank1, x.ref_id ref_id1, x.pos pos1, q1 mapq1, y.rank rank2, y.ref_id ref_id2, y.pos pos2, q2 mapq2, proper, tlen
        from resolved""",
    "sam_single": _SAM + " select * exclude (read_id, mate, ref_id) from sam where flag & 1 = 0",
    "sam_paired": _SAM + " select * exclude (read_id, mate, ref_id) from sam where flag & 1 = 1",
    "sam_plain": _sam_sql("plain") + " select * exclude (read_id, mate, ref_id) from sam",
    "sam_text": _SAM
    + """ select concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, 'NM:i:' || nm, 'AS:i:' || as_score, 'RG:Z:' || rg) as value from sam""",
    "sam_header": f"""with {REFS} select 0 part, 0 line_no, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' as value
        union all select 1, ref_id, '@SQ' || chr(9) || 'SN:' || ref_name || chr(9) || 'LN:' || length(seq) from refs where length(seq) > 0
        union all select 2, 0, '@RG' || chr(9) || 'ID:sf' || chr(9) || 'SM:sample' || chr(9) || 'PL:ILLUMINA'
        union all select 2, 1, '@PG' || chr(9) || 'ID:strandframe' || chr(9) || 'PN:strandframe'""",
    "sam_sorted": _SAM + " select read_id, mate, ref_id, pos, qname from sam order by ref_id nulls last, pos, qname, mate",
    "run_summary": _SAM
    + """, s as (select count(*) n, count(*) filter (flag & 4 = 0) mapped, coalesce(sum(length(seq)) filter (flag & 4 = 0), 0)::bigint b from sam),
        g as (select coalesce(sum(length(seq)), 0)::bigint g from refs)
        select n reads, mapped, round(100 * (mapped / n), 2) as percent, b mapped_bases, g genome_size, b / g mean_coverage from s, g""",
    "mapping_rate": _SAM
    + """, s as (select batch_id, count(*) total, count(*) filter (flag & 4 = 0) mapped from sam join reads using (read_id) group by 1)
        select batch_id, total, mapped, round(100 * (mapped / total), 2) as percent from s""",
    "reference_passes": f"""with {REFS} select ref_id,
        (coalesce(sum(coalesce(length(seq), 0)) over (order by ref_id rows between unbounded preceding and 1 preceding), 0) // 100000)::int ref_pass from refs""",
    "multipass_first": f"""with {PLANTED}, p as (select read_id, mate, rank, ref_id % 3 ref_pass, min(ref_id % 3) over (partition by read_id, mate) f from planted)
        select read_id, mate, rank, ref_pass from p where ref_pass = f""",
    "multipass_unmapped": f"with {PLANTED} select read_id, mate from reads, (values (1), (2)) x(mate) where (read_id, mate) not in (select (read_id, mate) from planted)",
    "multipass_mask": f"with {PLANTED} select read_id, bit_or(mate)::int mapped from planted group by 1",
    "eval_truth_parse": _JUDGED + " select * from truth",
    "eval_results": _JUDGED + " select * from results",
    "eval_metrics": _JUDGED
    + f""", c as (select tool, count(*) filter (verdict = 'TP') tp, count(*) filter (verdict = 'FP') fp, count(*) filter (verdict = 'FN') fn from judged group by 1)
        select tool, tp, fp, fn, {_scores("tp", "fp", "(tp + fp + fn)")} from c""",
    "eval_errors_top20": _JUDGED
    + """ select tool, qname, mate, ref, pos, rname, found, case when rname <> ref then 'Wrong Ref' else 'Dist ' || abs(found - pos) end error
        from judged where verdict = 'FP' order by qname, mate, tool limit 20""",
    "eval_r1": _JUDGED
    + f""", f as (select * from truth where mate = 1),
        s as (select tool, regexp_extract(qname, '^[^/]*') qname, rname, pos found from sam where flag & 2436 = 0),
        c as (select tool, (select count(*) from f) pairs, count(*) mapped, count(*) filter (rname = ref and abs(found - pos) < 30) correct from s join f using (qname) group by 1)
        select tool, pairs, mapped, correct, {_scores("correct", "(mapped - correct)", "pairs")} from c""",
    "eval_speedup": """with t as (select source, lang, sum(n_chars)::bigint chars from documents group by 1, 2),
        b as (select *, max(chars) filter (lang = 'en') over (partition by source) base from t)
        select source, lang, chars, case when chars > 0 then coalesce(base / chars, 0) else 0 end speed_up from b""",
    "sample_scaling": """with s as (select batch_id, count(*) reads from read_batch group by 1), k as (select *, row_number() over (order by batch_id) k from s),
        n as (select unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) n)
        select n, sum(reads)::bigint total from n join k on k <= n where n <= (select count(*) from s) group by 1""",
    "not_done": """select ref_id, index_id, length(ref_seq)::int length from ref_seqs
        where not exists (select 1 from seeds s where s.key44 >= 0 and s.ref_id = ref_seqs.ref_id)""",
    "eval_grid": """select coverage, mutation, tool, (select count(*) from documents where lang = tool) documents
        from (values (1), (3)) c(coverage), (values (0.001::double), (0.01::double)) m(mutation), (values ('en'), ('fr'), ('de'), ('es')) t(tool)""",
    "venn3_counts": _VARIANTS
    + """, m as (select a::int + 2 * n::int + 4 * r::int mask, count(*) n from k group by 1)
        select region, coalesce(n, 0) n from (values (1, 'A'), (2, 'N'), (3, 'A&N'), (4, 'R'), (5, 'A&R'), (6, 'N&R'), (7, 'A&N&R')) x(mask, region) left join m using (mask)""",
    "isec_counts": _VARIANTS
    + """ select 'A' region, count(*) filter (a and not n) n from k union all select 'N', count(*) filter (n and not a) from k union all select 'A&N', count(*) filter (a and n) from k""",
    "variant_f1": _VARIANTS
    + f", c as (select count(*) filter (a and n) tp, count(*) filter (a and not n) fp, count(*) filter (n and not a) fn from k) select tp, fp, fn, {_scores('tp', 'fp', '(tp + fn)')} from c",
    "set_difference": _VARIANTS + " select key from k where a and not n and not r",
    "set_intersection": _VARIANTS + " select key from k where a and n and not r",
    "topn_references": f"with {REFS} select ref_id, ref_name, length(seq)::int length from refs where seq is not null order by 3 desc, 1 limit 23",
}
