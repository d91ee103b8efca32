"""Module text made from the driver's tables, so that what is parsed back has a known answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = ["FORMAT: 2", "DIOCO_DOC_ID: d", "TARGET_LANG_G: fr", "HOME_LANG_G: en"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def gathered(df: DataFrame, keys: list[str], order: list[str], text: Column, name: str = "text") -> DataFrame:
    """Texts of each group in order, a line each."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct(*order, text.alias("__t"))))["__t"], "\n").alias(name))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per conversation: one dialogue, a turn's first line with its role, further lines as LINE."""
    turns = table(spark, sf_dir, "conversations")
    body = F.concat(F.initcap("role"), F.lit(": "), F.replace("text", F.lit("\n"), F.lit("\nLINE: ")))
    out = gathered(turns, ["conv_id"], ["turn", "role"], body, "body")
    head = joined(F.concat(F.lit("$MODULE Talk "), F.col("conv_id").cast("string")), *HEAD, "", "# made of conversations", F.concat(F.lit("$LESSON Lesson "), F.col("conv_id").cast("string")), "$DIALOGUE Talk {cover.jpg}", "REPEAT", "INTRO: Listen.")
    return out.select(F.col("conv_id").cast("string").alias("doc"), joined(head, F.col("body")).alias("text"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per customer: an activity per order, an item per line item, return flags as the pool of options."""
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey").cast("string")
    item = joined(F.when(F.col("l_linenumber") % 4 == 0, F.lit("\nEXAMPLE")).otherwise(F.lit("")), F.concat(F.lit("PROMPT: Part "), n, F.lit(" {p"), n, F.lit(".jpg} {c"), n, F.lit(".mp3}")), F.concat(F.lit("TEMPLATE: It is ____ "), F.col("l_linestatus")), F.concat(F.lit("ANSWER: "), F.col("l_returnflag")))
    items = gathered(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], item, "items")
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    act = joined(F.concat(F.lit("$SELECT Order "), F.col("o_orderkey").cast("string")), "OPTION: A | Accepted", "OPTION: N | New {new.png}", "OPTION: R | Returned", "OPTION: N | None", F.col("items"))
    out = gathered(orders, ["o_custkey"], ["o_orderkey"], act, "body")
    head = joined(F.concat(F.lit("$MODULE Customer "), F.col("o_custkey").cast("string")), *HEAD, "$LESSON Orders")
    return out.select(F.col("o_custkey").cast("string").alias("doc"), joined(head, F.col("body")).alias("text"))


def productions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per fifty parts: PROMPT name, RESPONSE brand, ACCEPT type and brand."""
    part = table(spark, sf_dir, "part").withColumn("book", F.floor(F.col("p_partkey") / 50))
    item = joined("", F.concat(F.lit("PROMPT: "), F.col("p_name")), F.concat(F.lit("RESPONSE: "), F.col("p_brand"), F.lit(" {r.mp3@1.5-2.5}")), F.concat(F.lit("ACCEPT: "), F.col("p_type"), F.lit(" | | "), F.col("p_brand")), "RUBRIC: same brand")
    out = gathered(part, ["book"], ["p_partkey"], item, "body")
    head = joined(F.concat(F.lit("$MODULE Parts "), F.col("book").cast("string")), *HEAD, "$PRODUCE Name the brand", "INPUT: either", "CHECK: LLM", "SHOW_PROMPT")
    return out.select(F.col("book").cast("string").alias("doc"), joined(head, F.col("body")).alias("text"))


def declared_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per region: its nations as speakers with voices, one of them twice."""
    nation = table(spark, sf_dir, "nation")
    name = F.col("n_name")
    voice = F.element_at(F.array(*map(F.lit, ("Puck", "kore", "Zephyr"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("VOICE: "), name, F.lit(" | "), voice, F.lit(" | calm | slow"))).otherwise(F.concat(F.lit("VOICE_SPEAKER: "), name, F.lit(" = "), voice))
    twice = joined(F.concat(F.lit("VOICE: "), name, F.lit(" | Leda")), line)
    out = gathered(nation, ["n_regionkey"], ["n_nationkey"], twice, "body")
    head = joined("$MODULE Voices", *HEAD, "VOICE_DEFAULT: Puck | warm")
    return out.select(F.col("n_regionkey").cast("string").alias("doc"), joined(head, F.col("body")).alias("text"))


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per part; the remainder of its key by 16 chooses a fault."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 16
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    text = joined(
        pick(0, "$MODULE", "$MODULE Parts"), pick(1, "FORMAT: 3", "FORMAT: 2"), "DIOCO_DOC_ID: d", pick(2, "# no target", "TARGET_LANG_G: fr"), "HOME_LANG_G: en",
        pick(3, "VOICE: Bob | Nobody", "VOICE: Bob | Puck"), pick(4, "COLOUR: red", "DESCRIPTION: x"), "", "$LESSON One", pick(5, " $DIALOGUE Talk", "# fine"), "$DIALOGUE Talk",
        pick(6, "Bob:", "Bob: Hello"), pick(7, "Ann: Hi", "bob: Hi"), pick(8, "Just words", "LINE: More {a.mp3}"), pick(9, "LINE: {a.mp3} tail", "LINE: tail"), "",
        pick(10, "$SELECT: Pick", "$SELECT Pick"), "OPTION: a | One", pick(11, "OPTION: two", "OPTION: b | Two"), "PROMPT: First", pick(12, "# no answer", "ANSWER: a"), pick(13, "# no blank", ""), "PROMPT: Second", "ANSWER: b", "",
        pick(14, "$SELECT Pick", "$PRODUCE Say"), pick(14, "PROMPT: p", "PROMPT: p"), pick(14, "ANSWER: a", "RESPONSE: r"), pick(15, "EXAMPLE", "# end"),
    )
    return part.select(F.col("p_partkey").cast("string").alias("doc"), text.alias("text"))
