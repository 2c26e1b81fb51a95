"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.llm import bpe, conversations, euclid, html, langid, lines, mixing, quality, resample, simhash, suffix, suffixtree, warc
from pathlight.llm.common import id_remainder, table
from pathlight.plans.lineage import scratch_path

#: Rank file of the byte-level BPE query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_langid_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0)
    contents = langid.learn(docs.where("not held_out"))
    found = langid.identify(docs, contents)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_suffix_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_runs(table(spark, sf_dir, "documents")).drop("removed")


def op4_risk_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(*quality.RULES)


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_archives(spark, folder))


def op6_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pstable_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclid.near_links(table(spark, sf_dir, "embeddings"))


def op8_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op9_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) != 2)


def op10_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_density,
        op2_langid_compression,
        op3_suffix_refinement,
        op4_risk_cutoffs,
        op5_warc_chunks,
        op6_simhash_blocks,
        op7_pstable_cosine,
        op8_bpe_segment_tree,
        op9_suffix_tree_score,
        op10_efraimidis_mix,
        op11_repair_grammar,
        op12_range_lines,
        op13_crc_resampling,
    )
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(
    f"substr({_LETTERS}, 1 + ((cast('0x' || substr(sha, {1 + 5 * g}, 5) as bigint) >> {shift}) & 31)::int, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of the bytes ``b``, half a byte at a time, by the 16 remainders of the reversed polynomial.
_NIBBLES = ", ".join(str(x) for x in (lambda step: [step(step(step(step(i)))) for i in range(16)])(lambda c: (c >> 1) ^ (0xEDB88320 * (c & 1))))
_HALF = "xor({c} >> 4, ([{t}])[(xor({c}, {b}) & 15) + 1])"
_CRC = "xor(list_reduce(b, lambda c, x: " + _HALF.format(c=_HALF.format(c="c", b="x", t=_NIBBLES), b="(x >> 4)", t=_NIBBLES) + ", 4294967295), 4294967295)"


def _features(source: str, id_: str) -> str:
    """``(id, w, f)``: the words of every text and its runs of one to three words."""
    runs = " || ".join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (1, 2, 3))
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"(select id, len(w) n_words, {runs} f from (select {id_} id, {words} w from {source}))"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KINDS = "case substr(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end"
#: Conversations by dynamic programming over their rows: ``ins`` are the rows inserted at one place and ``act`` what may be
#: done with a row, by state before (x) and after (y) and the role that results; states are 0 none, 1 s, 2 u, 3 a.
_CONVERSATIONS = f"""
    with recursive coded as (
           select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k
           from conversations),
         crc as (
           select k, ({_CRC}) % 20 code
           from (select k, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))) b from (select distinct k from coded))),
         hurt as materialized (
           select conv_id, turn, case code when 4 then 'user' else role end role,
                  case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
           from coded join crc using (k), range(2) t(i) where code <> 0 and (i = 0 or code = 3)),
         placed as materialized (
           select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) rn, {_KINDS} kind,
                  trim(text, {_WHITE}) bare from hurt),
         seen as (select *, row_number() over (partition by conv_id, role, text order by rn) nth,
                         lag(kind) over (partition by conv_id order by rn) kind_before from placed),
         faults as materialized (
           select conv_id, turn, role, text, rn, kind, bare = '' blank, bare <> '' and nth > 1 dup,
                  bare <> '' and nth = 1 and right(bare, 1) not in ('.', '!', '?') cut,
                  rn > 1 and (kind_before, kind) not in ((0, 1), (1, 2), (2, 1)) illegal from seen),
         ins(x, y, c, l, t) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
           (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'),
           (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
         act(x, y, kind, c, l, r) as (values (0, 1, 0, 0, 'K', null), (0, 2, 1, 0, 'K', null), (1, 2, 1, 0, 'K', null), (3, 2, 1, 0, 'K', null), (2, 3, 2, 0, 'K', null),
           (0, 2, null, 2, 'R', 'user'), (1, 2, null, 2, 'R', 'user'), (3, 2, null, 2, 'R', 'user'), (2, 3, null, 2, 'R', 'assistant'),
           (0, 0, null, 3, 'D', null), (1, 1, null, 3, 'D', null), (2, 2, null, 3, 'D', null), (3, 3, null, 3, 'D', null)),
         step as materialized (
           select i.x, a.y, a.kind, i.c + a.c c, i.l || a.l l, i.t t, a.l <> 'D' stays, a.r r from ins i join act a on i.y = a.x),
         dp as (
           select distinct conv_id, 0::bigint rn, 0 state, '00000000' best, '' made from faults union all
           select d.conv_id, f.rn, s.y, min(printf('%08d', left(d.best, 8)::bigint + s.c + (s.stays and f.cut)::int) || substr(d.best, 9) || s.l),
                  arg_min(d.made || s.t || case when s.stays then chr(10) || coalesce(s.r, f.role) || ':' || f.text else '' end,
                          printf('%08d', left(d.best, 8)::bigint + s.c + (s.stays and f.cut)::int) || substr(d.best, 9) || s.l)
           from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.rn = d.rn + 1
           join step s on s.x = d.state and (s.kind is null or s.kind = f.kind) and not (s.stays and (f.blank or f.dup))
           group by d.conv_id, f.rn, s.y),
         tails as (
           select conv_id, dp.rn, printf('%08d', left(best, 8)::bigint + c) || substr(best, 9) || l best, made || t made
           from dp join ins on x = state where y in (0, 3)),
         sums as (
           select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank,
                  count(*) filter (dup) duplicate, count(*) filter (cut) truncated, count(*) filter (illegal) illegal, count(*) n from faults group by conv_id),
         ends as (select t.conv_id, min(best) best, arg_min(made, best) made from tails t join sums s on t.conv_id is not distinct from s.conv_id and t.rn = s.n group by t.conv_id)
    select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
           coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(left(best, 8)::bigint, 0) "cost",
           coalesce(substr(best, 9), '') audit, sha256(coalesce(substr(made, 2), '')) repaired_sha256
    from (select distinct conv_id from conversations) o left join sums s on o.conv_id is not distinct from s.conv_id
    left join ends e on o.conv_id is not distinct from e.conv_id"""


SQL = {
    "op11_repair_grammar": _CONVERSATIONS,
    "op12_range_lines": f"""
        with l as (
               select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
             k as (
               select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}, {_LOWER}) key from l),
             g as (select key, min(doc_id) first from k where length(key) >= 10 group by key),
             d as (select doc_id, pos, line, first is not null and doc_id <> first dropped from k left join g using (key))
        select doc_id, count(*)::bigint n_lines, (count(*) filter (dropped))::bigint n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) kept_sha256
        from d group by doc_id""",
    "op13_crc_resampling": f"""
        with d as materialized {_features("documents", "doc_id")}, t as materialized {_features("benchmark", "null")},
             df as materialized (select id, unnest(f) f from d), tf as materialized (select unnest(f) f from t),
             known as (select f, hex(encode(f)) h from (select f from df union select f from tf)),
             coded as (select f, list_transform(range(1, len(h)::bigint, 2), lambda i: ('0x' || substr(h, i, 2))::bigint) b from known),
             crc as materialized (select f, ({_CRC}) % 10000 bucket from coded),
             s as (select bucket, count(*) s from df join crc using (f) group by bucket),
             u as (select bucket, count(*) t from tf join crc using (f) group by bucket),
             gain as materialized (
               select i bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from df) + 10000)::double)
                 / ((coalesce(s, 0) + 1)::double * ((select count(*) from tf) + 10000)::double)))::bigint gain
               from range(10000) r(i) left join s on s.bucket = i left join u on u.bucket = i),
             w as (select id, sum(gain)::bigint weight from df join crc using (f) join gain using (bucket) group by id),
             scored as materialized (
               select id doc_id, n_words, len(f)::bigint n_features, coalesce(weight, 0)::bigint weight,
                      coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint score
               from d left join w using (id)),
             r as (select doc_id, row_number() over (order by score desc, doc_id) r from scored where n_words >= 20)
        select doc_id, n_features, weight, score, case when r <= (select count(*) * 5 // 100 from r) then r end "rank"
        from scored left join r using (doc_id)""",
    "op5_warc_chunks": f"""
        with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) sha from pages),
             f as (select *, min(page_id) over (partition by sha, n) first from p)
        select page_id, n::bigint payload_bytes, {_BASE32} payload_digest,
               case when page_id = first then 'response' else 'revisit' end record_type,
               case when page_id = first then null else first end refers_to
        from f""",
    "op7_pstable_cosine": """
        with recursive v as (
               select vec_id, embedding::double[] e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) len
               from embeddings),
             l as (
               select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id
               where list_dot_product(a.e, b.e) >= 0.9 * a.len * b.len),
             r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on r.b = l.a),
             c as (select a vec_id, min(b) component_id from r group by a),
             n as (select a vec_id, count(*) n_links from l group by a)
        select vec_id, coalesce(n_links, 0)::bigint n_links, component_id::bigint component_id, vec_id = component_id kept
        from c left join n using (vec_id)""",
}
