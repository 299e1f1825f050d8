"""The quality patterns find what they found when every alternative had a boundary of its own, without trying each at every place."""

import random

from pyspark.sql import functions as F

from quarry.functions import text as T

PLAIN = {
    "figures": r"(?<![\w.])\d{1,3}(?:,\d{3})+(?![\d,.])|(?<![\w.])\d+(?:\.\d+)?\s?(?:%|percent|per cent)|[$€£¥]\s?\d",
    "cites": r"(?i)\bet al\.|\(\d{4}\)|\bdoi:|\bISBN\b|\bvol\.\s?\d+|\bpp?\.\s?\d+|\bJournal of\b|\bProceedings of\b|\barXiv\b",
    "insts": r"\b(?:University|Institute|Laborator(?:y|ies)|Ministry|Department of|Commission|Bureau|Agency|Foundation|Association|Society|WHO|CDC|NIH|NASA|OECD|IMF|IEEE|NIST|FDA|EPA)\b",
    "seo": r"(?i)\bin this (?:article|post|guide|blog)\b|\bwe will (?:delve|explore|dive)\b|\bkeep reading\b|\bread on\b|\blet'?s (?:dive|get started|explore)\b|\bclick here\b|\byou might be (?:thinking|wondering)\b|\bfrequently asked questions\b|\bthe ultimate guide\b|\beverything you need to know\b|\bin conclusion\b",
    "llm": r"(?i)\bdelve\b|\bdelving\b|\btapestry\b|\bnavigat(?:e|ing) the complexit|\btestament to\b|\bin today'?s (?:fast-paced|digital|modern) world\b|\bit'?s (?:important|worth) (?:to )?not(?:e|ing)\b|\bmultifaceted\b|\bplays a (?:crucial|pivotal|vital) role\b|\bcaptivating\b|\brealm of\b|\bunlock(?:ing)? the (?:power|potential|secrets)\b|\bembark on a journey\b|\bever-(?:evolving|changing) landscape\b",
}
SAID = """in this post|We will dive|keep reading|read on|let's explore|lets get started|click here|you might be wondering|frequently asked questions|the ultimate guide|everything you need to know|in conclusion
et al.|(1999)|doi:|ISBN|vol. 7|p. 3|pp.12|Journal of|proceedings of|arXiv|University|Institute|Laboratories|Ministry|Department of|Commission|Bureau|Agency|Foundation|Association|Society|WHO|CDC|NIH|NASA|OECD|IMF|IEEE|NIST|FDA|EPA
delve|delving|Tapestry|navigating the complexity|testament to|in today's digital world|it's worth noting|its important to note|multifaceted|plays a vital role|captivating|realm of|unlocking the power|embark on a journey|ever-changing landscape
1,234,567|12,345.6|3.5 %|40 percent|7 per cent|$ 5|€9|x12%|1.2,345|9""".replace("\n", "|").split("|")


def test_patterns_find_the_same(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", " "]).join(rng.choices([*SAID, "in", "x", ".", " ", "p"], k=12)) for _ in range(2000)] + SAID
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, plain in PLAIN.items():
        n, same = d.agg(F.sum(F.regexp_count("t", F.lit(plain))), F.count_if(F.regexp_count("t", F.lit(plain)) == F.regexp_count("t", F.lit(T.QUALITY[name])))).collect()[0]
        assert n > 100 and same == len(texts), name
        assert r"|\b" not in T.QUALITY[name] and "(?=[" in T.QUALITY[name]
