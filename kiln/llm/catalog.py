"""Queries of this subpackage, one per operator over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import align, embed_dedup, idfile, lines, mix, neighbours, pack, pii, repeats, secret_scan, simhash, spellings, tool_calls
from kiln.llm.redact import joined
from kiln.llm.scratch import prepare, table
from kiln.session import fresh_path

PACK_TOKENIZER, FILE_TOKENIZER, PIECE_TOKENIZER, END = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", 1

TOOLS: tool_calls.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calc": {"limit": ("integer", True), "note": ("string", False)},
    "fetch": {"query": ("string", True), "limit": ("number", False)},
}


def pieces(docs: DataFrame) -> DataFrame:
    packed = pack.pack(docs, PACK_TOKENIZER, END)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-balanced packing into sequences of 2048."""
    return pieces(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier, removed."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), text_out=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("repeats").cast("long").alias("n_repeats"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 at 150% of all words, none above twice its size."""
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to files in a byte-aligned code of frequency ranks, and read back."""
    path = fresh_path(spark, "llm-idfile")
    idfile.write_ids(table(spark, sf_dir, "documents"), path, FILE_TOKENIZER, END)
    return idfile.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked at 3 bits or fewer."""
    near = simhash.near_copies(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls from assistant turns and results from all other turns, each with its whole text.  Lengths of the
    texts decide the tool, how the arguments are (in)valid and which other calls a call waits for; a missing result is one
    whose identifier names no call."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t")).withColumn("n", F.length("t"))
    calls = turns.where("role = 'assistant'").withColumn("j", F.expr("to_json(struct(t as q))")).selectExpr(
        "conv_id",
        "concat('c', conv_id, '-', turn) as call_id",
        "turn",
        "if(n % 11 = 0, 'unknown', element_at(array('search', 'calc', 'fetch'), n % 3 + 1)) as tool",
        # {"q":"..."} without its first five characters and the last is the text as a JSON string
        """transform(array(substr(j, 6, length(j) - 6)), s -> case n % 7 when 0 then concat('[', s, ']') when 1 then concat('{"limit":', n, ',"note":', s, '}')
           when 2 then concat('{"limit":"', n, '","query":', s, '}') when 3 then concat('{"query":', s, ',"zeta":', n, '}') else concat('{"query": ', s, ', "limit": ', n, '}') end)[0] as arguments""",
        "array_compact(array(if(n % 2 = 0, concat('c', conv_id, '-', turn - 2), null), if(n % 17 = 0, concat('c', conv_id, '-', turn + 2), null))) as after",
    )
    results = turns.where("not (role <=> 'assistant')").selectExpr("conv_id", "concat('c', conv_id, '-', turn - 1, if(n % 13 = 0, '-lost', '')) as call_id", "turn", "t as content")
    return calls, results


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls linked to results, ordered, validated and serialised, with the whole text of every turn."""
    linked = tool_calls.link(*chat_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.select("conv_id", "call_id", "turn", "kind", F.coalesce("depth", F.lit(-1)).alias("depth"), F.array_join("errors", ",").alias("errors"), "n_results", "result", "json")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the words that reveal it."""
    found = pii.sanitise(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, x -> x.kind <> 'term')"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and the verdict of the line field."""
    docs = table(spark, sf_dir, "documents")
    return lines.judge(docs, lines.train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by blob, through a ledger that grows: a first scan of the older half of the ids, then one of all
    documents, which reads only blobs that the first has not seen."""
    docs, ledger = table(spark, sf_dir, "documents"), fresh_path(spark, "llm-ledger")
    middle = docs.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0]
    secret_scan.scan(docs.where(F.col("doc_id") <= F.lit(middle)), ledger)
    found = secret_scan.scan(docs, ledger).withColumn("base", F.expr("filter(spans, x -> x.kind in ('assign', 'access', 'hex'))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words, their form and their root."""
    return spellings.group(table(spark, sf_dir, "documents"))


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned by bytes, with counts of linked id pairs over all documents."""
    return align.align(table(spark, sf_dir, "documents"), PACK_TOKENIZER, PIECE_TOKENIZER)


OP3_SQL = r"""
with d as (
    select doc_id, coalesce(source, '') as s, source is null as no_source, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
    from documents),
src as (select s, no_source, sum(size)::bigint as source_size from d group by s, no_source),
ranked as (select *, row_number() over (order by no_source, encode(s)) - 1 as r from src),
weighed as (select *, case r % 3 when 0 then 5 when 1 then 2 else 1 end as w, 2.0::double * source_size as most from ranked),
summed as (
    select *, 1.5::double * sum(source_size) over () as all_words, sum(w) over () as all_w,
        coalesce(sum(w) over (order by most / w, r rows between unbounded preceding and 1 preceding), 0) as w0,
        coalesce(sum(most) over (order by most / w, r rows between unbounded preceding and 1 preceding), 0) as most0
    from weighed),
marked as (select *, w * (all_words - most0) / (all_w - w0)::double > most as is_full from summed),
rest as (select *, all_words - sum(case when is_full then most else 0 end) over () as words_left,
        all_w - sum(case when is_full then w else 0 end) over () as w_left from marked),
goal as (select s, no_source, source_size, case when is_full then most else w * words_left / w_left::double end as target from rest),
budget as (select *, floor(target)::bigint as b, case when source_size = 0 then 0 else floor(target)::bigint // source_size end as copies from goal),
run as (
    select d.doc_id, d.size, g.source_size, g.target, g.copies, g.b - g.copies * g.source_size as left_over,
        sum(d.size) over (partition by d.s, d.no_source order by d.h)::bigint - d.size as before
    from d join budget g on d.s = g.s and d.no_source = g.no_source)
select doc_id, size::bigint as size, source_size, target,
    (size * copies + greatest(0, least(size, left_over - before)))::bigint as taken
from run
"""

OP6_SQL = r"""
with recursive t as (
    select conv_id, turn, role, length(coalesce(text, '')) as n, coalesce(text, '') as t from conversations),
calls as (
    select conv_id, 'c' || conv_id || '-' || turn as call_id, turn, n, t, n % 7 as r,
        case when n % 11 = 0 then 'unknown' when n % 3 = 0 then 'search' when n % 3 = 1 then 'calc' else 'fetch' end as tool
    from t where role = 'assistant'),
waits as (
    select a.conv_id, a.call_id, b.call_id as dep from calls a join calls b
        on a.conv_id = b.conv_id and ((a.n % 2 = 0 and b.turn = a.turn - 2) or (a.n % 17 = 0 and b.turn = a.turn + 2))),
walk as (
    select conv_id, call_id, call_id as at_call, 0 as steps from calls
    union
    select k.conv_id, k.call_id, w.dep, k.steps + 1 from walk k join waits w on k.conv_id = w.conv_id and k.at_call = w.call_id where k.steps < 40),
deep as (select conv_id, call_id, max(steps) as steps from walk group by conv_id, call_id),
res as (select conv_id, 'c' || conv_id || '-' || (turn - 1) || case when n % 13 = 0 then '-lost' else '' end as call_id, turn, t as content from t where role is distinct from 'assistant'),
bad as (
    select *, case
        when tool = 'unknown' then 'unknown tool'
        when r = 0 then 'not an object'
        when tool = 'calc' then case r when 1 then '' when 2 then 'type limit,unexpected query' when 3 then 'missing limit,unexpected query,unexpected zeta' else 'unexpected query' end
        else case r when 1 then 'missing query,unexpected note' when 2 then 'type limit' when 3 then 'unexpected zeta' else '' end end as e
    from calls),
linked as (
    select b.*, case when d.steps >= 40 then null else d.steps end as depth, s.content, case when s.call_id is null then 0 else 1 end as n_results
    from bad b join deep d on b.conv_id = d.conv_id and b.call_id = d.call_id left join res s on b.conv_id = s.conv_id and b.call_id = s.call_id)
select conv_id, call_id, turn, 'call' as kind, coalesce(depth, -1)::int as depth,
    concat_ws(',', case when e = '' then null else e end, case when depth is null then 'cycle' end, case when n_results = 0 then 'no result' end) as errors,
    n_results::bigint as n_results, content as result,
    '{"arguments":' || case when e <> '' then 'null' when r = 1 then '{"limit":' || n || ',"note":' || to_json(t) || '}' else '{"limit":' || n || ',"query":' || to_json(t) || '}' end
        || ',"conversation":' || conv_id || ',"id":"' || call_id || '","result":' || coalesce(to_json(content)::varchar, 'null') || ',"tool":"' || tool || '"}' as json
from linked
union all
select s.conv_id, s.call_id, s.turn, 'orphan', -1, 'no call', 0, s.content, null
from res s left join calls c on s.conv_id = c.conv_id and s.call_id = c.call_id where c.call_id is null
"""

OP11_SQL = r"""
with recursive crc_table as (
    select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t),
runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) as run
    from documents where text is not null),
bytes as (select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from (select doc_id, run, count(*) as n from runs group by doc_id, run)),
crcs as (
    select run, n, xor(list_reduce(range(length(h) // 2), lambda c, i: xor(c // 256, t[(xor(c % 256, ('0x' || substr(h, 2 * i + 1, 2))::bigint) + 1)::bigint]), 4294967295), 4294967295) as crc
    from bytes, crc_table),
cut as (select case when crc % 31 = 0 then substr(run, 1, (crc % length(run))::bigint) || substr(run, (crc % length(run) + 2)::bigint) else run end as word, n from crcs),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
    select distinct a.word, b.word as other, b.n as m from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from less a join words b on a.rest = b.word
    union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (
    select word, count(*) as n_near, max(m) as m from near group by word),
formed as (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 10 * w.n then b.m end as form_n,
        case when b.m >= 10 * w.n then (select min(other) from near x where x.word = w.word and x.m = b.m) end as form
    from words w left join best b on w.word = b.word),
walk as (
    select word, word as at_word, 0 as steps from formed
    union all
    select w.word, f.form, w.steps + 1 from walk w join formed f on w.at_word = f.word where f.form is not null),
ends as (select word, arg_max(at_word, steps) as root from walk group by word)
select f.word, f.form, e.root, f.n::bigint as n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from formed f join ends e on f.word = e.word
"""

_QUERIES = (op1_pack, op2_repeats, op3_mix, op4_idfile, op5_simhash, op6_toolcalls, op7_pii, op8_neighbours, op9_lines, op10_secrets, op11_spellings, op12_embeddings, op13_alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {f.__name__: wrap(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": OP3_SQL, "op6_toolcalls": OP6_SQL, "op11_spellings": OP11_SQL}
