"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal-token blocks are allocated to sources by highest quotients ``target / (2k - 1)``; each source's
quota is apportioned the same way over its shards (hash buckets of documents). Inside a shard the
documents form one token stream in seeded order, cut into equal blocks, and a seeded systematic draw
takes each block ``floor(q/n)`` or ``ceil(q/n)`` times. The draw has a closed form, so no block is ever
materialised: a document's share is the difference of a cumulative function at its two ends.

Only quotients near the ideal quota are ranked (a divisor method's result lies within
``share * seats / 2 + 1`` of it), so the ranking grows with the number of sources and shards, not of blocks.
Everything is built from DataFrame functions. The one window over all rows holds one row per source.

Defined results: null text has size 0; null source is a source, ordered last; a document of size 0 is
taken 0 times; with no words at all every target is 0; an empty table gives an empty result. Rows that
agree in id, size and source are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.common import WORD, materialize

#: Documents of a shard, about; a source that the data favours is spread over all shards.
SHARD_DOCS = 2000
MAX_REPEAT = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s:"), source))


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes: skey, source, source_size. Adds weight (1, 2, 3, repeating, by code point) and target.

    Targets share all words by weight; those above ``max_repeat`` times the source's size are cut to that
    and the excess is shared again, which one pass in the order of cap / weight settles."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    ranked = ranked.withColumns({"cap": (max_repeat * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(everything)})
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("skey").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "rank": F.row_number().over(order),
        "level": (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).select("skey", "source_size", "weight", "target", "total")


def sainte_lague(claims: DataFrame, group: list[str], key: str, weight: str, seats: str, quota: str) -> DataFrame:
    """Apportion ``seats`` (a column, equal within a group) over the rows of each group; adds ``quota``.

    Each row's weight is a claim, equal quotients go to the smaller key."""
    whole = Window.partitionBy(*group)
    claims = claims.withColumns({"_share": F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(weight).over(whole)), F.lit(0.0)), "_rows": F.count("*").over(whole)})
    claims = claims.withColumns({"_near": F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"), "_reach": (F.ceil(F.col("_share") * F.col("_rows") / 2) + 1).cast("long")})
    claims = claims.withColumn("_sure", F.greatest(F.col("_near") - F.col("_reach"), F.lit(0))).withColumn("_need", F.col(seats) - F.sum("_sure").over(whole))
    tried = claims.filter(F.col(weight) > 0).select(*group, key, weight, "_need", F.explode(F.sequence(F.col("_sure") + 1, F.col("_near") + F.col("_reach"))).alias("_k"))
    place = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), F.col(key).asc())
    won = tried.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= F.col("_need")).groupBy(*group, key).agg(F.count("*").alias("_won"))
    return claims.join(won, [*group, key], "left").withColumn(quota, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).drop("_share", "_rows", "_near", "_reach", "_sure", "_need", "_won")


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    scattered = F.shiftright(F.pmod(F.pmod(number, F.lit(2**31)) * 2654435761 + seed, F.lit(2**32)), 16)
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), n_words(F.col(text_col)).alias("size"), scattered.alias("scattered")), "mix-sizes")
    totals = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    shards = F.greatest(F.lit(1), F.least(F.lit(65536), F.ceil(F.sum("n_docs").over(everything) / SHARD_DOCS))).cast("long")
    targets = source_targets(totals).join(totals.select("skey", shards.alias("n_shards")), "skey")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    targets = targets.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(256), F.floor(least / 64))), F.lit(1)).cast("long"))
    targets = targets.withColumns({"blocks": F.floor(F.col("total") / F.col("block") + 0.5).cast("long"), "_all": F.lit(0)})
    targets = materialize(sainte_lague(targets, ["_all"], "skey", "target", "blocks", "quota").drop("_all"), "mix-targets")

    placed = sized.join(targets.select("skey", "n_shards"), "skey").withColumn("shard", F.col("scattered") % F.col("n_shards")).drop("n_shards", "scattered")
    lengths = placed.groupBy("skey", "shard").agg(F.sum("size").alias("length")).join(targets, "skey")
    quotas = sainte_lague(lengths, ["skey"], "shard", "length", "quota", "shard_quota")
    n = F.ceil(F.col("length") / F.col("block")).cast("long")
    quotas = quotas.withColumn("n", n).select("skey", "shard", "source_size", "target", "block", "n", F.least(F.col("shard_quota"), max_repeat * F.col("n")).alias("q"))
    stream = Window.partitionBy("skey", "shard").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), F.col("id"), F.col("size"))
    ends = placed.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = ends.join(quotas, ["skey", "shard"])
    start_at = (seed * 7919 + F.col("shard") * 104729) % F.col("n")

    def drawn(blocks: Column) -> Column:
        return F.floor((blocks * F.col("q") + start_at) / F.col("n")).cast("long")

    def upto(tokens: Column) -> Column:
        """Words taken from the first ``tokens`` of the stream."""
        whole = F.floor(tokens / F.col("block")).cast("long")
        return F.col("block") * drawn(whole) + (tokens - whole * F.col("block")) * (drawn(whole + 1) - drawn(whole))

    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(upto(F.col("end")) - upto(F.col("end") - F.col("size"))).cast("long")
    return mixed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix as whole documents: every row of ``docs`` 0 to 3 times, with all its columns.

    A document's share ``taken / size`` is rounded up or down by a hash of its id, so a source's words
    keep near its target. Documents without words take their source's rate, target / source_size, as share
    (a source without any words: 1)."""
    mixed = mix_sources(docs, text_col, id_col, source_col, seed)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(1.0))
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(rate)
    key = F.struct(F.col(id_col).cast("string").alias("id"), source_key(F.col(source_col)).alias("skey"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"copies {seed}:"), F.coalesce(F.col("key.id"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2**32
    # Rows that agree in id and source are decided alike, by their sum.
    copies = mixed.withColumns({"key": key, "share": share}).groupBy("key").agg(F.avg("share").alias("share"))
    copies = copies.select("key", F.floor(F.col("share") + draw).cast("int").alias("copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, key.alias("key")).join(copies, "key").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


#: The same mix in SQL: all quotients ranked, the stream and the draw written out.
SQL = r"""
with sized as (
  select doc_id, source, case when source is null then 'n' else 's:' || source end as skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (((coalesce(doc_id, -1) % 2147483648 + 2147483648) % 2147483648 * 2654435761 + 17) % 4294967296) // 65536 as scattered
  from documents),
ranked as (
  select skey, sum(size)::bigint as source_size, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::bigint as weight,
         (3 * sum(size))::double as cap, (sum(sum(size)) over ())::bigint as total,
         greatest(1, least(65536, ceil((sum(count(*)) over ()) / 2000.0)))::bigint as n_shards
  from sized group by skey, source),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over (order by cap / weight, skey rows between current row and unbounded following))::double as level
  from ranked),
targets as (
  select skey, source_size, total, n_shards,
         case when cap / weight <= level then cap else weight * (select level from levels where cap / weight > level order by cap / weight, skey limit 1) end as target
  from levels),
block as (select greatest(1, least(256, floor(min(case when target > 0 then target end) / 64)))::bigint as block from targets),
seats as (
  select t.*, b.block, floor(total / b.block::double + 0.5)::bigint as blocks from targets t, block b),
quotients as (
  select skey, row_number() over (order by target / (2 * k - 1) desc, skey) as place, blocks
  from (select skey, target, blocks, unnest(range(1, blocks + 1)) as k from seats where target > 0)),
quotas as (select skey, count(*) as quota from quotients where place <= blocks group by skey),
placed as (
  select d.doc_id, d.skey, d.size, s.source_size, s.target, s.block, d.scattered % s.n_shards as shard, coalesce(q.quota, 0) as quota
  from sized d join seats s using (skey) left join quotas q using (skey)),
shards as (
  select skey, shard, any_value(block) as block, any_value(quota) as quota, sum(size)::bigint as length from placed group by skey, shard),
won as (
  select skey, shard, count(*) as q from (
    select skey, shard, quota, row_number() over (partition by skey order by length / (2 * k - 1)::double desc, shard) as place
    from (select skey, shard, quota, length, unnest(range(1, quota + 1)) as k from shards where length > 0))
  where place <= quota group by skey, shard),
draws as (
  select s.skey, s.shard, ceil(s.length / s.block::double)::bigint as n, least(coalesce(w.q, 0), 3 * ceil(s.length / s.block::double))::bigint as q
  from shards s left join won w using (skey, shard)),
streamed as (
  select p.*, d.n, d.q, (17 * 7919 + p.shard * 104729) % d.n as u,
         (sum(p.size) over (partition by p.skey, p.shard order by md5('17:' || coalesce(p.doc_id::varchar, '')), p.doc_id, p.size rows unbounded preceding))::bigint as e
  from placed p join draws d using (skey, shard))
select doc_id, size, source_size, target,
  case when size = 0 then 0 else
    block * (((e // block) * q + u) // n) + (e - (e // block) * block) * ((((e // block) + 1) * q + u) // n - ((e // block) * q + u) // n)
    - block * ((((e - size) // block) * q + u) // n) - ((e - size) - ((e - size) // block) * block) * (((((e - size) // block) + 1) * q + u) // n - (((e - size) // block) * q + u) // n)
  end::bigint as taken
from streamed
"""
