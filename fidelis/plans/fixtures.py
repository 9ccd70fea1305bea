"""Papers rendered from the star schema, one an order, and revisions of them by known mutations.

Their facts are columns, so what extraction must find is known without reading the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Values of the papers, as SQL over orders (Spark and DuckDB alike).
FACTS = {
    "firms": "100 + o_orderkey % 900",
    "share": "10 + o_orderkey % 80",
    "money": "1 + o_custkey % 500",
    "year": "2001 + o_orderkey % 9",
    "coef": "10 + o_orderkey % 89",
    "level": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 5 END",
    "cite": "2 + o_orderkey % 90",
    "score": "1000 + o_custkey % 700",
    "word": "substr(CASE WHEN o_orderkey % 2 = 0 THEN '甲乙丙丁戊己庚' ELSE 'abcdefg' END, CAST(1 + o_orderkey % 7 AS INTEGER), 1)",
}
#: Mutations: name, what is replaced by what (None: see mutated), the rule it must meet (None: it must pass).
OPS = [
    ("identity", None), ("count_changed", "atom_changed"), ("percent_changed", "atom_changed"), ("range_shrunk", "atom_changed"), ("coefficient_changed", "atom_changed"),
    ("citation_dropped", "citation_lost"), ("citation_added", "citation_added"), ("doi_changed", "doi_url_changed"), ("url_changed", "doi_url_changed"), ("term_changed", "term_drift"),
    ("number_added", "new_data_atom"), ("number_dropped", "atom_missing"), ("cell_changed", "frozen_region_modified"), ("heading_dropped", "structure_broken"), ("code_changed", "frozen_region_modified"),
    ("percent_as_share", None), ("money_rescaled", None), ("dash_variant", None), ("p_case", None),
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one small file of a single row group: its rows are dealt out, as far larger texts are made of them
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition(max(2, spark.sparkContext.defaultParallelism))
    return orders.selectExpr("o_orderkey AS doc_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'zh' ELSE 'en' END AS lang", *[f"{sql} AS {name}" for name, sql in FACTS.items()])


TEMPLATES = {
    "zh": "## 研究结果\n\n值得注意的是，本文在{year}—2020年间调查了{firms}家企业。占比为{share}%。金额为{money}万元。首先，β=0.{coef}，p<0.0{level}，其次在{level}%水平上显著。对照{score}，与研究相符。Chen & Zhao（2019）也有发现[{cite}]。"
    "近三年数据截至2021年3月。指标ROA与ROA一致。见https://example.org/d/{doc_id}。doi: 10.1234/x.{doc_id}。“稳健性”成立，供应链{word}型稳定。\n\n| 变量 | 值 |\n|---|---|\n| A | {score} |\n\n```\nrun {doc_id}\n```\n\n## 参考文献\n\n[1] 旧文。\n",
    "en": "## Results\n\nIt is worth noting that in {year}–2020 we surveyed {firms} firms. The share was {share}%. Moreover, the cost was {money}万元. However, β=0.{coef} and p<0.0{level} hold. The score was {score} here, Chen & Zhao (2019) agree [{cite}]. "
    "Data end in March 2021. The ROA and ROA agree. See https://example.org/d/{doc_id} for more. The doi: 10.1234/x.{doc_id} holds. A \"robust\" chain{word}model is stable.\n\n| Variable | Value |\n|---|---|\n| A | {score} |\n\n```\nrun {doc_id}\n```\n\n## References\n\n[1] Old text.\n",
}
TERMS = {"zh": "供应链{word}型", "en": "chain{word}model"}


#: Texts with the forms that the papers lack, and pairs of a text and its revision that state the same in other words.
NOTES = "王明（{year}）指出，百分之{share}始于20{year2}-03-15，p值为0.0{level}，系数为-0.{coef}，n={firms}。It held (Smith, {year}) in 1998 too. 近十年共{score}.1234567890123与99999999999999999999999999999.{coef}1。\n"
FACTS["year2"] = "10 + o_orderkey % 9"
BRIDGES = [("在{level}%水平上显著。", "p<0.0{level}。", "equivalent"), ("p≤0.0{level}。", "在{level}%水平上显著。", "equivalent"), ("p>0.0{level}。", "在{level}%水平上显著。", "missing"), ("p<0.0{level}。", "P＜0.0{level}。", "equivalent")]


#: Attributions, and their revisions that swap the citations, by doc_id; a move of a fact to the next paragraph.
BOUND = "张三调查了{firms}家企业[{cite}]。李四发现占比为{share}%[{cite2}]。\n\n另有{score}例。\n"
SWAPPED = "张三调查了{firms}家企业[{cite2}]。李四发现占比为{share}%[{cite}]。\n\n另有{score}例。\n"
MOVED = "张三调查了{firms}家企业[{cite}]。李四发现占比为{share}%[{cite2}]。另有{score}例。\n\n如此。\n"
FACTS["cite2"] = "101 + o_orderkey % 90"


def rendered(template: str) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def rendered_sql(template: str) -> str:
    """The same as SQL text of both engines."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(f"CAST({x} AS VARCHAR)" if i % 2 else quoted(x) for i, x in enumerate(parts))


def papers_sql() -> str:
    """WITH clause of DuckDB: facts and papers."""
    facts_ = ", ".join(f"{sql} AS {name}" for name, sql in FACTS.items())
    return (
        f"WITH facts AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, {facts_} FROM orders), "
        f"papers AS (SELECT doc_id, lang, CASE WHEN lang = 'zh' THEN {rendered_sql(TEMPLATES['zh'])} ELSE {rendered_sql(TEMPLATES['en'])} END AS text FROM facts) "
    )


def notes(spark: SparkSession, sf_dir: str, template: str = NOTES) -> DataFrame:
    """doc_id, text: one an order."""
    return facts(spark, sf_dir).select("doc_id", rendered(template).alias("text"))


def bridges(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """doc_id, text: originals (0) or revisions (1) of BRIDGES, by doc_id."""
    cases = F.array(*[rendered(b[side]) for b in BRIDGES])
    return facts(spark, sf_dir).select("doc_id", F.get(cases, (F.col("doc_id") % len(BRIDGES)).cast("int")).alias("text"))


def _papers(f: DataFrame) -> DataFrame:
    """facts with text and glossary."""
    zh = F.col("lang") == "zh"
    text = F.when(zh, rendered(TEMPLATES["zh"])).otherwise(rendered(TEMPLATES["en"]))
    return f.withColumns({"text": text, "glossary": F.array(F.when(zh, rendered(TERMS["zh"])).otherwise(rendered(TERMS["en"])))})


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text, glossary."""
    return _papers(facts(spark, sf_dir)).select("doc_id", "lang", "text", "glossary")


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, op, expect (the rule that must appear, null: must pass), text: the mutation is doc_id % 19."""
    rows = _papers(facts(spark, sf_dir)).withColumn("op", F.element_at(F.array(*[F.lit(n) for n, _ in OPS]), (F.col("doc_id") % len(OPS) + 1).cast("int")))
    s = lambda c: F.col(c).cast("string")
    cat = F.concat
    lit = F.lit
    zh = F.col("lang") == "zh"
    dash = F.when(zh, "—").otherwise("–")
    scaled = cat(s("money"), lit("0,000元"))
    edits: dict[str, tuple[Column, Column]] = {
        "count_changed": (cat(s("firms"), F.when(zh, "家").otherwise(" firms")), cat((F.col("firms") + 7).cast("string"), F.when(zh, "家").otherwise(" firms"))),
        "percent_changed": (cat(s("share"), lit("%")), cat((F.col("share") + 3).cast("string"), lit("%"))),
        "range_shrunk": (cat(dash, lit("2020")), cat(dash, lit("2018"))),
        "coefficient_changed": (cat(lit("β=0."), s("coef")), cat(lit("β=0.0"), s("coef"))),
        "citation_dropped": (cat(lit("["), s("cite"), lit("]")), lit("")),
        "citation_added": (cat(lit("["), s("cite"), lit("]")), cat(lit("["), s("cite"), lit("][199]"))),
        "doi_changed": (lit("10.1234/x."), lit("10.1234/y.")),
        "url_changed": (lit("example.org/d/"), lit("example.org/e/")),
        "term_changed": (F.element_at("glossary", 1), F.when(zh, "网络布局").otherwise("network plan")),
        "number_added": (F.element_at("glossary", 1), cat(F.element_at("glossary", 1), F.when(zh, "，覆盖率89.25%").otherwise(" at 89.25%"))),
        "number_dropped": (cat(F.when(zh, "对照").otherwise("was "), s("score")), F.when(zh, "对照").otherwise("was fair")),
        "cell_changed": (lit("| A |"), lit("| B |")),
        "heading_dropped": (F.when(zh, "## 研究结果").otherwise("## Results"), lit("")),
        "code_changed": (lit("\nrun "), lit("\nwalk ")),
        "percent_as_share": (cat(F.when(zh, "占比为").otherwise("The share was "), s("share"), lit("%")), cat(F.when(zh, "占比为0.").otherwise("The proportion of 0."), s("share"))),
        "money_rescaled": (cat(s("money"), lit("万元")), scaled),
        "dash_variant": (cat(s("year"), dash, lit("2020")), cat(s("year"), lit("至2020"))),
        "p_case": (lit("p<0.0"), lit("P<0.0")),
    }
    text = F.col("text")
    for op, (old, new) in edits.items():
        text = F.when(F.col("op") == op, F.replace(F.col("text"), old, new)).otherwise(text)
    rule = F.create_map(*[F.lit(x) for n, r in OPS if r for x in (n, r)])
    return rows.select("doc_id", "op", F.try_element_at(rule, F.col("op")).alias("expect"), text.alias("text"))
