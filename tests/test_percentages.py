from pyspark.sql import functions as F

from veriframe.functions import percentages

CASES = [  # prompt, type, options, key, what is to be found
    ("What is 12.5% of 80?", "choice", ["10", "12.5"], 0, ("CALCULATED", "10", 0, "AGREES")),
    ("what percent of 8 is 3", "choice", ["37.5%", "0.375%"], 1, ("CALCULATED", "37.5%", 0, "CONFLICT")),
    ("3 is what percentage of 8?", "choice", ["37.5", "40%"], 0, ("CHOICES", "37.5%", None, None)),
    ("What percent of 3 is 1? Express the answer to the nearest tenth of a percent", "choice", ["33.3%", "33%"], None, ("CALCULATED", "33.3%", 0, "NO_KEY")),
    ("What percent of 3 is 1?", "choice", ["33.3%", "33%"], 0, ("NO_CHOICE", "100/3%", None, None)),
    ("What percent of 8 is 1. Round to the nearest whole percent. Round your answer to the nearest whole percent", "choice", ["13%"], 0, ("UNKNOWN", None, None, None)),
    ("What percent of 8 is 1? Round your answer to the nearest whole percent", "choice", ["13%"], 0, ("HALFWAY", None, None, None)),
    ("10 is 20% of 50", "true/false", ["False", "True"], 1, ("CALCULATED", "true", 1, "AGREES")),
    ("10 is 20% of 51", "true/false", ["False", "True"], 1, ("CALCULATED", "false", 0, "CONFLICT")),
    ("10 is 20% of 50", "true/false", ["Yes", "No"], 1, ("LABELS", "true", None, None)),
    ("10 is 20% of 50", "choice", ["True", "False"], 0, ("OTHER_TYPE", None, None, None)),
    ("10 is 20% of what?", "choice", [], None, ("CALCULATED", "50", None, None)),
    ("5% of 40", "choice", ["2", "4/2"], 0, ("SEVERAL_CHOICES", "2", None, None)),
    ("5% of 40 is 2 of course", "choice", ["2"], 0, ("UNKNOWN", None, None, None)),
    ("5% of 40", "essay", ["2"], 0, ("UNKNOWN", None, None, None)),
    ("What percent of 0 is 4", "choice", ["0%"], 0, ("UNSUPPORTED", None, None, None)),
    ("−5% of 40", "choice", ["-2"], 0, ("CALCULATED", "-2", 0, "AGREES")),
    (None, None, None, None, ("UNKNOWN", None, None, None)),
]


def test_answers(spark):
    rows = [(i, *c[:4]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, prompt string, kind string, options array<string>, key int")
    check = percentages.answer_check(F.col("prompt"), F.col("kind"), F.col("options"), F.col("key"))
    got = {r["i"]: tuple(r["a"]) for r in df.select("i", check.alias("a")).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}
