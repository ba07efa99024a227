"""Words looked up at once against their regular expressions, one by one."""

import random
import time

from pyspark.sql import functions as F

from brandloom.functions import text
from brandloom.operators import brand
from brandloom.plans import rules

WORDS = [w for w, _ in rules.PARTNERSHIP_WORDS + rules.GOAL_WORDS] + [w for _, w in rules.PLATFORM_WORDS] + ["a?b|colou?r|1:1", "installs?"]


def test_words_are_those_of_their_expressions(spark):
    r = random.Random(3)
    parts = ["ugc", "x", "x.com", "youtu.be", "youtu-be", "sign-up", "sign ups", "signups", "install", "installss", "app  installs", "app installs", "top of funnel", "Top Of Funnel", "ig", "big", "é", "İg", "ig_", "\n", "", "😀", "demo request", "demo requests.", "ads", "landing page click", "ab", "b", "color", "colour", "1:1", "1", "K", "ROI"]
    rows = [("".join(r.choice(parts) + r.choice([" ", "", ", ", "-", "_", "\n", "é"]) for _ in range(r.randint(0, 9))),) for _ in range(1_500)] + [(p,) for p in parts]
    df = spark.createDataFrame(rows, "t string").select(F.lower("t").alias("t")).withColumn("s", text.spaced(F.col("t")))
    pairs = df.select(*[F.struct(text.held_word(F.col("t"), F.col("s"), w).alias("a"), text.any_word(F.col("t"), w).alias("b")).alias(f"w{i}") for i, w in enumerate(WORDS)]).collect()
    assert all(x.a == x.b for row in pairs for x in row) and all(any(row[i].b for row in pairs) for i in (0, 4, 8, 12, len(WORDS) - 1))


def test_intent_costs_less_than_its_expressions(spark):
    """Each expression over each text was 10 ms a text."""
    prose = "the people of the town went over to the old mill and sat there for a long while, as they always do in the spring of the year. " * 4
    df = spark.range(4_000).select(F.concat(F.lit(prose), F.col("id")).alias("t"))
    each = df.select(*[text.any_word(F.lower("t"), w).alias(f"w{i}") for i, w in enumerate(WORDS[:15])])

    def seconds(rows):
        rows.limit(10).write.format("noop").mode("overwrite").save()
        began = time.time()
        rows.write.format("noop").mode("overwrite").save()
        return time.time() - began

    assert seconds(brand.intent(df, "t")) < 0.5 * seconds(each)
