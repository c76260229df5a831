"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.llm import (
    bpe, chat, codes, jaccard, language, mixing, pieces, quality, repeats, rules, sharding, topk, variants,
)
from recordforge.llm.work import documents, n_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is omitted where plain SQL cannot say it on whole tables."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_jaccard_components")
def jaccard_components(spark, sf_dir):
    return jaccard.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query(
    "op2_top_inner_products",
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    s as (select q.vec_id as query_id, x.vec_id, list_dot_product(q.v, x.v)::bigint as score
      from v q join v x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id and len(q.v) = len(x.v)),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5
    """,
)
def top_inner_products(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(table, F.col("vec_id") % 50 == 0)


# DuckDB's regular expressions need a literal class; [\x20\x09-\x0D] are the separators.
SQL_WORDS = "length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


@query(
    "op3_mix_sources",
    f"""
    with d as (select doc_id, source, {SQL_WORDS} as size from documents),
    s as (
      select source, sum(size)::bigint as source_size,
             [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight
      from d group by source),
    r as (
      select *, 3 * source_size as cap,
             sum(source_size) over () as all_size, sum(weight) over () as all_weight,
             sum(3 * source_size) over w as caps, sum(weight) over w as weights
      from s window w as (order by 3 * source_size / weight rows between unbounded preceding and current row)),
    l as (select max((all_size - (caps - cap))::double / (all_weight - (weights - weight))::double) as level from r),
    t as (select source, source_size, least(cap::double, level * weight) as target from r, l),
    p as (
      select d.doc_id, d.source, d.size, t.source_size, t.target,
             case when t.source_size > 0 then t.target / t.source_size else 0.0 end as ratio,
             row_number() over (partition by d.source
                                order by d.size, md5(concat('0:', coalesce(d.doc_id::varchar, '')))) - 1 as place,
             ('0x' || substr(md5(concat('0:', coalesce(d.source, ''))), 1, 8))::bigint / 4294967296.0 as u
      from d join t on d.source is not distinct from t.source),
    q as (select *, ratio - floor(ratio) as fraction from p),
    o as (
      select source, k, (u + k / 16.0) % 1 as v,
             abs(sum((floor(fraction * (place + 1) + (u + k / 16.0) % 1) - floor(fraction * place + (u + k / 16.0) % 1)) * size)
                 - max(fraction * source_size)) as error
      from q, range(16) as k(k) group by source, k, u),
    b as (select source, min_by(v, k) as v
          from (select *, min(error) over (partition by source) as least_error from o) where error = least_error group by source)
    select doc_id, size::bigint as size, source_size, target,
           ((floor(ratio) + floor(fraction * (place + 1) + v) - floor(fraction * place + v)) * size)::bigint as taken
    from q join b on q.source is not distinct from b.source
    """,
)
def mix_sources(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_lpt_shards")
def lpt_shards(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir, "doc_id", "text"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    coded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def id_remainder(n: int):
    """crc32 of the doc_id written as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op5_quality_scores")
def quality_scores(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder(5) != 0)
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op10_language")
def language_of(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language.identify(docs, id_remainder(3) != 1, ["doc_id"])
    return found.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_rule_votes")
def rule_votes(spark, sf_dir):
    return rules.rule_verdicts(documents(spark, sf_dir, "doc_id", "text"))


@query("op8_repeated_passages")
def repeated_passages(spark, sf_dir):
    cut = repeats.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    # Texts without removals still hold their own separators.
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def _sql_side(side: str, even: int) -> str:
    return f"""
    {side} as (
      select p.pair_id, p.n_shared,
        coalesce(string_agg(case when place > n_shared then body end, '' order by place), '') as {side},
        coalesce(list(runs order by place) filter (where place > n_shared), []) as runs
      from p left join t on t.pair_id = p.pair_id and t.side = {even} group by all)"""


def pair_of(conv_id: str):
    """Half of an id, rounded down, in whole numbers: exact for ids of any size."""
    return F.expr(f"({conv_id} - pmod({conv_id}, 2)) div 2")


@query(
    "op9_preference_pairs",
    f"""
    with raw as (
      select conv_id // 2 as pair_id, conv_id % 2 as side, turn, role, text,
        concat('<|im_start|>', coalesce(role, ''), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) as body,
        [struct_pack(chars := length(coalesce(role, '')) + 13, learn := false),
         struct_pack(chars := length(coalesce(text, '')) + 11, learn := coalesce(role = 'assistant', false))] as runs
      from conversations where conv_id is not null),
    t as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role nulls first, text nulls first)
          as place from raw),
    c as (select a.pair_id, a.place, a.role is not distinct from b.role and a.text is not distinct from b.text as same
          from t a join t b on a.pair_id = b.pair_id and a.place = b.place and a.side = 0 and b.side = 1),
    p as (select pair_id, coalesce(least(min(first_off), max(n)), 0)::int as n_shared from (
            select t.pair_id, c.place as n, case when not c.same then c.place - 1 end as first_off
            from (select distinct pair_id from t) t left join c using (pair_id)) group by pair_id),
    {_sql_side("chosen", 0)}, {_sql_side("rejected", 1)}
    select p.pair_id, p.n_shared,
      coalesce((select string_agg(body, '' order by place) from t
                where t.pair_id = p.pair_id and side = 0 and place <= p.n_shared), '') as prompt,
      chosen, flatten(a.runs)::varchar as chosen_mask, rejected, flatten(b.runs)::varchar as rejected_mask
    from p join chosen a using (pair_id) join rejected b using (pair_id)
    """,
)
def preference_pairs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = chat.format_preferences(turns, pair_of("conv_id"), F.pmod("conv_id", F.lit(2)) == 0)
    shown = lambda c: F.concat(  # noqa: E731  as text, to be compared with SQL
        F.lit("["),
        F.array_join(
            F.transform(
                c, lambda r: F.format_string("{'chars': %d, 'learn': %s}", r["chars"], r["learn"].cast("string"))
            ),
            ", ",
        ),
        F.lit("]"),
    )
    return pairs.withColumns({c: shown(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def _sql_rounds(rounds: int) -> str:
    """Codebooks c1, c2, ... of SQL, each from the one before; `a` assigns with integers d * 16 + entry."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
    a{i} as materialized (
      select r, part, min(d * 16 + entry)::bigint as best from (
        select p.r, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x))::bigint as d
        from p join c{i} c using (part, pos) group by all) group by all)""")
        if i < rounds:
            out.append(f"""
    c{i + 1} as materialized (
      select c.part, c.entry, c.pos, coalesce(m.x, c.x) as x from c{i} c left join (
        select part, best % 16 as entry, pos, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::bigint as x
        from p join a{i} using (r, part) group by all) m using (part, entry, pos))""")
    return ",".join(out)


@query(
    "op11_vector_codes",
    f"""
    with k as materialized (
      select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label,
             list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v, len(embedding) // 8 as width
      from embeddings where embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    p as materialized (
      select r, (i - 1) // width as part, (i - 1) % width as pos, v[i] as x
      from (select r, width, v, unnest(range(1, len(v) + 1)) as i from k)),
    c0 as materialized (select part, r as entry, pos, x from p where r < 16),
    {_sql_rounds(6)},
    e as materialized (
      select r, string_agg(printf('%02x', best % 16), '' order by part) as code, sum(best // 16)::bigint as error
      from a6 group by r),
    s as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from c6)
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
    from k join e using (r), s
    """,
)
def vector_codes(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = codes.compress(table)
    told = codes.with_group_sum(coded.drop("embedding"), "label", "error", "label_error")
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_piece_round_trip")
def piece_round_trip(spark, sf_dir):
    coded = pieces.encode(documents(spark, sf_dir, "doc_id", "text"), piece_file())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _crc_table() -> list[int]:
    """The table of crc32, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


@query(
    "op13_spelling_variants",
    f"""
    with runs as materialized (
      select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)
      where length(run) >= 7 group by all),
    named as materialized (
      select run, n, hex(encode(concat(coalesce(doc_id::varchar, ''), ':', run))) as bytes from runs),
    hashed as materialized (
      select run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(bytes), 2), lambda i: ('0x' || bytes[i:i + 1])::bigint)),
        lambda c, b: xor(c >> 8, ({_crc_table()}::bigint[])[xor(c & 255, b) + 1]))) as h from named),
    words as materialized (
      select word, sum(n)::bigint as n from (
        select case when h % 31 = 0 then run[:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end as word, n
        from hashed)
      where length(word) >= 7 group by word having sum(n) >= 2),
    cut as materialized (
      select word, n, i, word[:i - 1] || word[i + 1:] as rest
      from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
    near as materialized (
      select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b
        on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union select a.word, a.n, w.word, w.n from cut a join words w on a.rest = w.word
      union select w.word, w.n, a.word, a.n from cut a join words w on a.rest = w.word),
    told as materialized (
      select word, count(*) as n_near, max(other_n) as most, min((-other_n, encode(other))) as best
      from near group by word),
    forms as materialized (
      select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
             case when most >= 10 * w.n then decode(best[2]) end as form, case when most >= 10 * w.n then most end as form_n
      from words w left join told using (word)),
    paths as (
      with recursive path(word, place, steps) as (
        select word, word, 0 from forms
        union all select p.word, f.form, p.steps + 1 from path p join forms f on p.place = f.word where f.form is not null)
      select word, max_by(place, steps) as root from path group by word)
    select word, form, root, n, n_near, form_n from forms join paths using (word)
    """,
)
def spelling_variants(spark, sf_dir):
    return variants.spelling_variants(documents(spark, sf_dir, "doc_id", "text"))
