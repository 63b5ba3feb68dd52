"""Classifiers of questions, and what questions name, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lookup_key

# Terms by which a question's kind is told. They count as substrings wherever they stand.
COMPLEX = [
    "first find", "first, find", "first determine", "then calculate", "then determine", "then find", "step by step", "multi-step", "multi-hop", "multi-part", "multiple questions", "several parts",
    "首先找到", "首先确定", "然后计算", "然后确定", "分步", "多步", "多个问题", "几个部分", "先找到", "先确定", "再计算", "再确定",
]
COMPARISON = ["compare", "difference", "versus", "vs", "对比", "比较", "区别", "不同", "相比"]
TABLE = ["table", "metric", "value", "表", "指标", "数值"]
PARAMETER = ["parameter", "参数"]
PARAMETER_CONTEXT = ["value", "values", "数值", "值", "是多少", "列出", "list", "table", "表", "unit", "单位"]
UNITS = r"(?iu)\bkcal\b|Å|\bangstrom\b|\d+%"
EVIDENCE = ["citation", "cite", "reference", "source", "evidence", "引用", "证据", "来源", "原文"]
NUMBERED = r"(^|\n)\s*[1-9]\d*\."
HIGH_RISK = ["better", "best", "recommend", "advice", "which method"]
NEEDS_SOURCE = ["原文", "出处", "证据", "摘录", "quote", "quoted", "exact", "verbatim", "source"]
CROSS_PAPER = ["compare", "comparison", "versus", " vs ", " v.s.", "between", "across papers", "multiple papers", "跨论文", "比较", "对比", "相比", "差异", "区别"]
DIFFERENCE = ["compare", "comparison", "difference", "versus", " vs ", "相比", "差异", "对比", "比较", "变化", "改善", "降低", "提高", "一致", "从", "到"]
LIMITATION = ["limitation", "limitations", "drawback", "drawbacks", "shortcoming", "shortcomings", "weakness", "weaknesses", "不足", "局限", "问题", "缺点"]
OVERVIEW_MARKERS = ["概述", "介绍", "概括", "总结", "核心", "主要", "新增", "扩展", "覆盖", "包括", "列出", "定位", "总体"]
CAUSAL = ["为什么", "为何", "原因", "机制", "怎么产生", "如何产生", "怎么造成", "如何造成", "如何", "怎么"]
METRICS = "auc|precision|recall|accuracy|bleu|rouge|rmse|mae|mse|hfe|hvap|metric|score|performance|oie2016|nyt|penn|web"
TABLE_REFERENCE = r"第[一二两三四五六七八九十百\d]+张|这张|那张|这个表|那个表|(刚才|前面|上面|之前|上一).{0,8}表|展开.{0,10}表"
PARAMETERISATION = r"(?i)\b(parameterization|parameterisation|resp|cmap|qm level|charge fitting)\b"
SCIENTIFIC = r"(?i)\b(amber|charmm|cmap|drude|ff\d+[a-z0-9-]*|flucct|fret|lfmm|opls[a-z0-9-]*|resp|sparta|tip4p[-a-z0-9]*)\b"
FIGURE_TABLE = r"(?i)(Figure\s*(?:S\s*)?\d+|Table\s*(?:S\s*)?(?:\d+|[IVXLCDM]+)|Fig\.\s*(?:S\s*)?\d+|Appendix\s+[A-Z])"
DATASETS = r"(?i)\b(OIE2016|NYT|PENN|WEB|CoNLL|ACE|SemEval|WikiSQL|SQuAD|GLUE|SuperGLUE)\b"
COMPONENTS = r"(?i)\b(Generator|Verifier|Pruner|Retriever|OpenIE\s*6|Stanford\s*OIE|DeepEx|PIVE|ChatGPT|GPT-4|LLaMA|Qwen)\b"
CHINESE_COMPONENTS = {"生成器": "Generator", "验证器": "Verifier", "修剪器": "Pruner", "裁剪器": "Pruner", "检索器": "Retriever", "数据集": "dataset", "消融": "ablation", "指标": "metric"}
OVERVIEW_CHINESE = (
    "这篇.{0,6}(文章|论文|文献).{0,20}?(讲(了|些)?(什么|哪些内容)|主要内容|创新点|贡献|是关于|是干什么|研究(了|些)?什么)"
    "|总结|概括|简述|概述|介绍|大意|主旨|主题|(讲|说|谈|写).{0,2}了?什么"
)
OVERVIEW_ENGLISH = r"\bsummarize\b|\boverview\b|\bwhat\s+is\s+(this|the)\s+(paper|article|document)\s+about\b|\bwhat\s+does\s+(this|the)\s+(paper|article|document)\s+(discuss|cover|talk\s+about)\b|\bmain\s+(content|points?|idea|contribution)"
METHOD_FACET = r"研究方法|实验方法|方法论|实验流程|技术路线|算法|实现细节|如何实现|怎么做|\b(methodology|methods?|approach|algorithm|pipeline|experimental\s+setup|implementation)\b"
HEADINGS = r"(?i)^(abstract|introduction|conclusion|related work|methods?|methodology|results?|discussion|references?|acknowledgements?|appendix)(\s+\d+)?\s*$"
#: A follow-up question as it is put to retrieval: behind the turn before it (fixed values).
PREVIOUS, CURRENT = "上一轮问题：", "\n当前追问："
FOLLOW_UP_LENGTH = 30
BLANK = " \t\n\r\x0b\f"


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def any_of(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def route(question: Column) -> Column:
    """The route of a question, by falling priority."""
    q = F.trim(_low(question), F.lit(BLANK))
    table = any_of(q, TABLE) | (any_of(q, PARAMETER) & any_of(q, PARAMETER_CONTEXT)) | q.rlike(UNITS)
    return (
        F.when(q == "", "needs_clarification")
        .when(any_of(q, COMPLEX) | (F.regexp_count(q, F.lit(NUMBERED)) >= 2), "complex_multi_hop")
        .when(any_of(q, COMPARISON), "multi_source_compare")
        .when(table, "table_or_metric")
        .when(any_of(q, EVIDENCE), "evidence_required")
        .otherwise("simple_rag")
    )


def requires_citations(question: Column) -> Column:
    return route(question) != "needs_clarification"


def max_retries(question: Column) -> Column:
    return F.when(route(question).isin("multi_source_compare", "table_or_metric", "evidence_required"), 1).otherwise(0)


def is_table(question: Column) -> Column:
    q = _low(question)
    return q.rlike(r"table\s*(s\s*)?(\d+|[ivxlcdm]+)\b") | any_of(q, ["表", "tabular"])


def is_table_reference(question: Column) -> Column:
    """Whether a question points at a table without naming what is in it."""
    return F.coalesce(question, F.lit("")).rlike(TABLE_REFERENCE)


def is_figure(question: Column) -> Column:
    q = _low(question)
    return q.rlike(r"figure\s*\d+") | q.rlike(r"fig\.?\s*\d+") | any_of(q, ["图", "illustration", "diagram"])


def is_metric(question: Column) -> Column:
    q = _low(question)
    pka = q.rlike(r"\bpka\b") & any_of(q, ["table", "表", "数值", "误差", "改善", "shift", "rmse", "error", "value"])
    return any_of(q, ["指标", "分数", "得分"]) | q.rlike(r"(?<![a-z0-9])f\s*1(?![a-z0-9])") | q.rlike(rf"\b({METRICS})\b") | pka


def is_formula(question: Column) -> Column:
    q = _low(question)
    return q.rlike(r"\b(formula|equation|eq\.)\b") | any_of(q, ["公式"])


def is_mechanism(question: Column) -> Column:
    """Questions for a cause, unless they ask for a table, a metric, a figure or an overview."""
    q = _low(question)
    return ~(is_table(question) | is_metric(question) | is_figure(question)) & ~any_of(q, OVERVIEW_MARKERS) & (any_of(q, CAUSAL) | q.rlike(r"\bwhy\b|\bmechanism\b"))


def is_scientific(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(SCIENTIFIC)


def current_question(question: Column) -> Column:
    """A follow-up's own part: behind the last mark of the current question."""
    q = F.coalesce(question, F.lit(""))
    return F.when(F.startswith(q, F.lit(PREVIOUS)) & F.contains(q, F.lit(CURRENT)), F.substring_index(q, CURRENT, -1)).otherwise(q)


def is_overview(question: Column) -> Column:
    """Whether a question asks what a document is about, and nothing more special."""

    def of(c: Column) -> Column:
        q = F.lower(c)
        special = q.rlike(METHOD_FACET) | is_table(c) | is_metric(c) | is_figure(c) | is_scientific(c)
        return (q.rlike(OVERVIEW_CHINESE) | q.rlike(OVERVIEW_ENGLISH)) & ~special

    return let(current_question(question), of)


def is_cross_paper(question: Column) -> Column:
    return any_of(_low(question), CROSS_PAPER)


def is_difference(question: Column) -> Column:
    return any_of(_low(question), DIFFERENCE)


def is_limitation(question: Column) -> Column:
    return any_of(_low(question), LIMITATION)


def is_parameterisation(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return any_of(q, ["参数化", "验证规模"]) | q.rlike(PARAMETERISATION)


def high_risk(question: Column) -> Column:
    return any_of(_low(question), HIGH_RISK)


def needs_source(question: Column) -> Column:
    return any_of(_low(question), NEEDS_SOURCE)


def is_chinese(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike("[\\u4e00-\\u9fff]")


def heading_only(text: Column) -> Column:
    """Whether a text is a heading or a label and nothing else. Its substance, the lines that aren't Markdown headings, must
    have 50 characters and eight words or twenty CJK signs."""

    def of(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANK))), lambda x: (x != "") & ~x.rlike(r"^#+\s+"))
        words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
        rich = let(F.trim(F.array_join(lines, "\n"), F.lit(BLANK)), lambda s: (F.length(s) >= 50) & ((words(s) >= 8) | (F.length(F.regexp_replace(s, "[^\\u4e00-\\u9fff]", "")) >= 20)))
        return (t == "") | (~rich & ((F.length(t) < 50) | (words(t) < 8) | t.rlike(HEADINGS)))

    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK)), of)


def _once(values: Column, key) -> Column:
    """The first of values with each key, in order; such without a key are left out."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: (key(x) != "") & (F.array_position(keys, key(x)) == i + 1))


def figure_table_anchors(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return F.concat(F.regexp_extract_all(q, F.lit(FIGURE_TABLE), F.lit(1)), F.regexp_extract_all(q, F.lit(r"[图表]\s*\d+"), F.lit(0)))


def dataset_anchors(question: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(DATASETS), F.lit(1))


def facets(question: Column) -> Column:
    """Figures, tables, datasets and components that a question names, each once whatever its case, in this order."""
    q = F.coalesce(question, F.lit(""))
    chinese = F.filter(F.array(*[F.when(F.contains(q, F.lit(k)), F.lit(v)) for k, v in CHINESE_COMPONENTS.items()]), lambda x: x.isNotNull())
    found = F.concat(figure_table_anchors(q), dataset_anchors(q), F.regexp_extract_all(q, F.lit(COMPONENTS), F.lit(1)), chinese)
    return let(F.transform(found, lambda x: F.trim(x)), lambda v: _once(v, F.lower))


#: Words that say nothing of a table's content (fixed values).
GENERIC = (
    "what which where when does drawn from for table metrics metric values value score scores performance system systems accuracy precision recall ablation study results result how are the and or to into with between "
    "compared compare comparison improve improved improvement improvements change changes show shows report reports reported given experiment experimental consistency consistent"
).split()
METRIC_NAMES = ["f1", "auc", "precision", "recall", "accuracy"]


def table_terms(question: Column, most: int = 16) -> Column:
    """Words of a question that a table may hold: three characters and more, generic words and names of metrics left out;
    hyphenated numbers count as well. Each once by its key, ``most`` at most, which the operator's rule sets."""
    q = F.coalesce(question, F.lit(""))
    words = F.filter(F.regexp_extract_all(q, F.lit(r"\b[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*\b"), F.lit(0)), lambda w: (F.length(lookup_key(w)) >= 3) & ~lookup_key(w).isin(GENERIC) & ~lookup_key(w).isin(METRIC_NAMES))
    numbers = F.regexp_extract_all(q, F.lit(r"\b\d+(?:[-_][A-Za-z0-9]+)+\b"), F.lit(0))
    named = F.regexp_extract_all(q, F.lit(r"\b[A-Za-z0-9_-]*[Dd]ataset[-_\s]*[A-Za-z0-9_-]+\b"), F.lit(0))
    return F.slice(let(F.concat(words, numbers, named), lambda v: _once(v, lookup_key)), 1, most)


def follow_up(question: Column, previous: Column) -> Column:
    """A question as retrieval gets it: one of at most 30 characters is put behind the previous one, if that is another."""
    q = F.trim(question, F.lit(BLANK))
    wraps = (F.length(q) <= FOLLOW_UP_LENGTH) & previous.isNotNull() & (F.trim(previous, F.lit(BLANK)) != q)
    return F.when(wraps, F.concat(F.lit(PREVIOUS), previous, F.lit(CURRENT), q)).otherwise(question)
