"""The extraction passes, marker phrases and gate rules as data."""

from __future__ import annotations

from dataclasses import dataclass

#: Full-width characters and what they stand for in values.
WIDE, NARROW = "０１２３４５６７８９（）＜＞＝％：，", "0123456789()<>=%:,"
#: Chinese digits, units within a section, and units that close one.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
BIG = {"万": 10_000, "亿": 100_000_000}

NUMERIC = ["amount", "coefficient", "count", "date", "number", "p_value", "percent", "range", "significance"]
DEDICATED = ["citation_numbered", "citation_ay", "url", "doi"]
#: Kinds whose additions are no violation of their own.
NOT_ADDED = [*DEDICATED, "term", "variable", "phrase"]


@dataclass(frozen=True)
class Pass:
    """kind, pattern, how the canonical form is built from the groups, and the group that is claimed."""

    kind: str
    pattern: str
    form: str
    claim: int = 0
    #: Characters one of which every match holds: where none occurs, the pass is skipped.
    holds: str = ""


# Patterns in order of precedence; the first to claim a character keeps it.
_YEAR = r"(?:19|20)\d{2}"
_LEFT = r"(?<![0-9A-Za-z.])"
PASSES = [
    Pass("url", r"""https?://[^\s<>（）()【】{}"'，。；、！？]+""", "url", holds="/"),
    Pass("doi", r"(?i)(?:doi\s*[:：]?\s*|https?://(?:dx\.)?doi\.org/)\s*(10\.\d{4,9}/[^\s，。；）)】]+)", "doi", 1, holds="/"),
    Pass("citation_numbered", r"\[(\d{1,3}(?:\s*[,，]\s*\d{1,3})*)\]", "cites", holds="["),
    Pass("citation_ay", rf"([一-鿿]{{2,4}}?)(?:等)?\s*[（(]\s*({_YEAR})\s*[）)]", "cite_ay", holds="(（"),
    Pass("citation_ay", rf"([A-Z][A-Za-z&.\- ]{{1,40}}?)\s*[（(]\s*({_YEAR})\s*[）)]", "cite_ay", holds="(（"),
    Pass("citation_ay", rf"\(([A-Z][A-Za-z&.\- ]{{0,40}}?),\s*({_YEAR})\)", "cite_ay", holds="(（"),
    Pass("significance", r"在\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*的?水平(?:上)?\s*显著", "sig", holds="在"),
    Pass("percent", r"百分之\s*([0-9]+(?:\.[0-9]+)?)", "pct", holds="百"),
    Pass("percent", r"([0-9]+(?:\.[0-9]+)?)\s*[%％]", "pct", holds="%％"),
    Pass("percent", r"(?:占比|比例|份额|percent(?:age)?|proportion)\s*(?:为|是|of|:|：)?\s*(0\.[0-9]+)", "pct_share", holds="."),
    Pass("amount", r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(万|亿)?\s*(万元|亿元|美元|人民币|元)", "amount", holds="元币"),
    Pass("date", rf"{_LEFT}({_YEAR})-([01][0-9])-([0-3][0-9])(?!\d)", "iso", holds="-"),
    Pass("range", rf"{_LEFT}({_YEAR})\s*(?:[—–\-~～]|至|到)\s*({_YEAR})(?!\d)(?:\s*年)?", "range", holds="—–-~～至到"),
    Pass("date", rf"({_YEAR})\s*年(?:\s*([0-9]{{1,2}}|[一二三四五六七八九十]{{1,3}})\s*月)?", "zh_date", holds="年"),
    Pass("date", rf"(?<![A-Za-z])(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?,?\s+({_YEAR})(?!\d)", "en_date", holds="JFMASOND"),
    Pass("p_value", r"(?<![A-Za-z0-9])[pP]\s*值?\s*([<＜>＞≤≥=＝])\s*(0?[0-9]*\.[0-9]+)", "p", holds="<＜>＞≤≥=＝"),
    Pass("p_value", r"(?<![A-Za-z0-9])[pP]\s*值\s*(?:为|是)\s*(0?[0-9]*\.[0-9]+)", "p_is", holds="值"),
    Pass("coefficient", r"β\s*[=＝]\s*(-?[0-9]+(?:\.[0-9]+)?)", "coef", holds="β"),
    Pass("coefficient", r"系数(?:为|是)?\s*(-?[0-9]+(?:\.[0-9]+)?)", "coef", holds="系"),
    Pass("phrase", r"(近|过去)\s*([0-9一二两三四五六七八九十]+)\s*年", "phrase", holds="年"),
    Pass("count", r"(?<![A-Za-z0-9])[nN]\s*[=＝]\s*([0-9][0-9,]*)", "count", holds="=＝"),
    Pass("count", r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(家|名|人|份|例|篇|条|项|种)", "count", holds="家名人份例篇条项种"),
    Pass("count", r"(?i)([0-9][0-9,]*)\s+(firms|participants|respondents|samples|observations|countries)", "count", holds="sSſ"),
    Pass("date", rf"{_LEFT}({_YEAR})(?![0-9])", "year"),
    Pass("number", rf"{_LEFT}(-?[0-9]+(?:\.[0-9]+)?)(?![0-9A-Za-z])", "num"),
]
HEADING, REFERENCES = r"^(#{1,6})\s+(.+?)\s*#*\s*$", r"(?i)^(?:references|bibliography|参考文献)$"
VARIABLE = r"(?<![A-Za-z0-9])[A-Z]{2,8}(?![A-Za-z0-9])"
QUOTED = Pass("term", "[\"“]([^\"”]{2,24})[\"”]", "term")
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
P_SIGNS = {"<": "lt", "≤": "le", ">": "gt", "≥": "ge", "=": "eq"}

# Marker phrases of templated writing, by language and family.
MARKERS = {
    "zh": {
        "template": ["值得注意的是", "需要注意的是", "值得一提的是", "综上所述", "总而言之", "众所周知", "毋庸置疑", "不可否认", "一方面", "另一方面", "具体而言", "换句话说", "与此同时"],
        "chain": ["首先", "其次", "再次", "最后"],
        "connective": ["此外", "同时", "因此", "然而", "总之", "另外", "由此可见", "相比之下", "但是", "并且"],
        "banned": ["说白了", "其实呢", "咱们"],
    },
    "en": {
        "template": ["it is worth noting that", "it is important to note that", "it should be noted that", "delve into", "in conclusion", "in summary", "moreover", "furthermore", "additionally", "notably", "importantly", "overall", "plays a crucial role"],
        "chain": ["first", "second", "third", "finally"],
        "connective": ["however", "moreover", "furthermore", "additionally", "therefore", "thus", "nevertheless", "overall", "in addition", "consequently"],
        "banned": ["gonna", "kind of", "a bit of"],
    },
}

# Section types by the first group whose keyword the lower-cased title holds.
SECTIONS = [
    ("abstract", ["摘要", "abstract"]),
    ("intro", ["引言", "绪论", "introduction", "研究背景"]),
    ("related", ["文献", "综述", "related", "literature"]),
    ("methods", ["方法", "数据", "模型设定", "method", "data", "materials"]),
    ("results", ["结果", "实证", "findings", "results", "回归"]),
    ("discussion", ["讨论", "discussion"]),
    ("conclusion", ["结论", "conclusion", "总结"]),
]

# Gate rules, judge verdicts, variant thresholds.
HARD_RULES = ["atom_changed", "atom_missing", "new_data_atom", "citation_lost", "citation_added", "citation_rebound", "doi_url_changed", "claim_contradicted", "claim_dropped", "claim_strength_shift", "new_claim_added", "frozen_region_modified", "structure_broken", "over_edit", "term_drift"]
SOFT_RULES = ["atom_moved_cross_paragraph", "numeric_added_warning", "rhythm_residual"]
VERDICT_RULES = {"weakened": "claim_strength_shift", "strengthened": "claim_strength_shift", "contradicted": "claim_contradicted", "dropped": "claim_dropped", "added_new": "new_claim_added"}
THRESHOLDS = {
    "A": {"density_max": 2.0, "density_cut": 0.5, "cv_delta": 0.10, "edit_low": 0.15, "edit_high": 0.65, "natural_min": 4.0, "natural_delta": 1.0},
    "B": {"density_max": 3.0, "density_cut": 0.3, "cv_delta": 0.05, "edit_low": 0.10, "edit_high": 0.55, "natural_min": 3.5, "natural_delta": 0.5},
    "C": {"density_max": None, "density_cut": None, "cv_delta": -0.10, "edit_low": 0.0, "edit_high": 0.15, "natural_min": None, "natural_delta": 0.5},
}
