"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by parent links. Pointer doubling (an iterated self-join of slim rows) finds for each message the head
of its unbranched run; runs are gathered once, and a frontier join from the leaves' runs up to the roots enumerates the
root-to-leaf paths, so a long conversation without branches costs a few joins and not one for each turn. Branches of a
conversation are ranked by the sum of their messages' scores (ties: the smaller leaf), and each chosen path is formatted.

Template: `<s>[INST]role[/INST]text</s>` for each turn. In roles and texts a backslash is doubled and the four control
strings get a backslash after their first character, so no control string is left in them and unescaping is exact. The
loss mask is a list of code-point spans, one for each assistant text.

Null roles and texts are empty. A parent that doesn't exist makes its child a root; messages whose parents run in a
circle belong to no path and are left out. Messages with a null conv_id are one conversation of their own. Equal rows are messages of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stage import staged

# The template's control strings.
BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, total, place, id): the messages of each chosen root-to-leaf path, place counting from the root;
    the best `keep` of each conversation, or all.

    messages: conv_id, id (unique in its conversation), parent (null for roots), score.
    """
    return _paths(messages.withColumn("conv_id", _whole("conv_id")), keep).withColumn("conv_id", F.col("conv_id.of"))


def _whole(name: str) -> Column:
    """A conv_id as a struct, which is never null, so that joins meet null ones too."""
    return F.struct(F.col(name).alias("of"))


def _paths(messages: DataFrame, keep: int | None) -> DataFrame:
    m = messages.select("conv_id", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select("conv_id", F.col("id").alias("parent"), F.lit(True).alias("there"))
    children = m.groupBy("conv_id", "parent").agg(F.count(F.lit(1)).alias("siblings"))
    m = m.join(known, ["conv_id", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")
    m = m.join(children, ["conv_id", "parent"], "left")
    # a run goes on upward where the message is its parent's only child
    slim = staged(m.select("conv_id", "id", "parent", "score", F.when(F.col("siblings") == 1, F.col("parent")).alias("up")), "messages")
    jump = slim.select("conv_id", "id", F.coalesce("up", "id").alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("up").isNull().alias("done"))
    largest = slim.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < largest and not jump.where("not done").isEmpty():
        # only messages whose run goes on need another jump
        to = jump.select("conv_id", F.col("id").alias("head"), F.col("head").alias("h2"), F.col("far").alias("f2"), F.col("done").alias("d2"))
        moved = jump.where("not done").join(to, ["conv_id", "head"]).select("conv_id", "id", F.col("h2").alias("head"), (F.col("far") + F.col("f2")).alias("far"), F.col("d2").alias("done"))
        jump = staged(jump.where("done").unionByName(moved), "jump")
        reach *= 2
    jump = jump.where("done")
    # in a circle nothing is ever done; its messages drop out here
    runs = slim.join(jump.select("conv_id", "id", "head", "far"), ["conv_id", "id"]).groupBy("conv_id", "head").agg(
        F.array_sort(F.collect_list(F.struct("far", "id"))).alias("run"), F.sum("score").alias("score"), F.max(F.struct("far", "id")).getField("id").alias("last"), F.max(F.when(F.col("far") == 0, F.col("parent"))).alias("above")
    )
    runs = staged(runs.select("conv_id", "head", "last", "score", "above", F.transform("run", lambda r: r.id).alias("ids")), "runs")
    inner = runs.where("above is not null").select("conv_id", F.col("above").alias("last")).distinct()
    front = runs.join(inner, ["conv_id", "last"], "left_anti").select("conv_id", F.col("last").alias("leaf"), "above", "score", "ids", F.lit(0).alias("depth"))
    whole, depth = front.where("above is null"), 0
    front = staged(front.where("above is not null"), "front")
    while depth < largest and not front.isEmpty():
        up = runs.select("conv_id", F.col("last").alias("above"), F.col("above").alias("a2"), F.col("score").alias("s2"), F.col("ids").alias("i2"))
        front = staged(front.join(up, ["conv_id", "above"]).select("conv_id", "leaf", F.col("a2").alias("above"), (F.col("score") + F.col("s2")).alias("score"), F.concat("i2", "ids").alias("ids"), (F.col("depth") + 1).alias("depth")), "front")
        whole = whole.unionByName(front.where("above is null"))
        front = front.where("above is not null")
        depth += 1
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    return ranked.select("conv_id", "leaf", "rank", F.col("score").alias("total"), F.posexplode("ids").alias("place", "id"))


def format_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss array<struct<start, size>>), one row for each chosen path."""
    messages = messages.withColumn("conv_id", _whole("conv_id"))
    said = messages.select("conv_id", "id", F.coalesce("role", F.lit("")).alias("role"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    rows = _paths(messages, keep).join(said, ["conv_id", "id"])
    turns = rows.groupBy("conv_id", "leaf").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("place", "role", "r", "t"))).alias("turns"))
    one = lambda x: F.concat(F.lit(BEGIN + HEAD), x.r, F.lit(TAIL), x.t, F.lit(END))
    empty = F.array().cast("array<struct<start:int,size:int>>")
    head, fixed = F.lit(len(BEGIN + HEAD + TAIL)), F.lit(len(BEGIN + HEAD + TAIL + END))
    step = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + fixed + F.length(x.r) + F.length(x.t)).alias("at"),
            F.when(x.role == "assistant", F.concat(acc.spans, F.array(F.struct((acc.at + head + F.length(x.r)).alias("start"), F.length(x.t).alias("size"))))).otherwise(acc.spans).alias("spans"),
        ),
    )
    return turns.select(F.col("conv_id.of").alias("conv_id"), "leaf", "rank", F.array_join(F.transform("turns", one), "").alias("formatted"), step.spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted rows with turns array<struct<role, text>> and the unescaped texts under the loss mask."""
    parts = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    pair = lambda x: F.split(F.substring(x, len(BEGIN + HEAD) + 1, 1 << 30), r"\[/INST\]", -1)
    turns = F.transform(parts, lambda x: F.struct(unescape(pair(x)[0]).alias("role"), unescape(pair(x)[1]).alias("text")))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.size))))


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row replies to the one before it, by turn (ties: role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("id"))
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    # a conversation that is given in turns has one branch, which is the best ranked
    out = read_back(format_paths(linear(rows.unionByName(probe)), keep=1))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)),
e as (select *, length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]'))
              + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) + 20 as chars from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(length(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant')), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""
