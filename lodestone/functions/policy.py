"""Rules that classify questions, documents and answers, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns over lower-case questions, over documents, and phrases of answers
NARROW = [
    r"как\w*\s+(убедиться|проверить|узнать|найти|получить|скачать|открыть)", r"где\s+(найти|скачать|посмотреть|открыть)", r"что\s+(такое|означает|является)",
    r"какой\s+(пароль|срок|размер|номер|формат|статус)", r"каки[ех]\s+исключени", r"каки[ех]\s+особы", r"каки[ех]\s+альтернатив", r"почему\s+", r"можно\s+ли\s+",
]
BROAD = [
    r"подробно", r"объясни\s+вс[ёе]", r"расскажи\s+про", r"как\w*\s+(работает|устроено|происходит|проводится)", r"порядок\s+(получения|выдачи|оформления|получить)",
    r"система\s+\w+", r"вс[ёе]\s+про\b", r"полностью", r"детальн", r"максимальн", r"каки[ех]\s+(условия|требования|правила|нормы|критерии)", r"перечисл\w*",
    r"что\s+входит", r"что\s+включ\w+", r"список\s+\w+", r"какие\s+\w+\s+нужн",
]
COMPOUND = [r"сравни\s+.+\s+и\s+", r"расскажи\s+про\s+.*\s+и\s+", r"как\w*\s+.*\s+и\s+", r"что\s+.*\s+и\s+что\s+", r"какие\s+.*\s+и\s+какие\s+", r"опиши\s+.*\s+а\s+также\s+", r"объясни\s+.*\s+и\s+"]
LEGAL_QUESTION = [
    r"вправе\s+ли", r"обязан\s+ли", r"подлежит\s+ли", r"несёт\s+ли\s+ответственность", r"стать[юяе]\s+\d+", r"пункт[ае]?\s+\d+", r"в\s+соответствии\s+с",
    r"согласно\s+(закону|договору|статье)", r"нарушени[ея]\s+(условий|закона)",
]
EXACT_REFERENCE = r"(статья|пункт|раздел|глава|параграф|п\.|ст\.)\s*\d+"
LEGAL_MARKERS = [
    r"\nСтатья\s+\d+", r"\nГлава\s+\d+", r"\nРаздел\s+\d+", r"\nПункт\s+\d+", r"\n\d+\.\d+\.", r"Федеральный закон", r"ГК РФ", r"НК РФ",
    r"настоящ(им|его|ий)\s+(договор|соглашени)", r"стороны\s+договорились",
]
NOT_FOUND = ["не найден", "не найдена", "не найдено", "нет информации", "не удалось найти", "информация не найдена", "в предоставленных документах", "в документах нет", "не обнаружен"]
BREADTH_NAMES = {"short": "narrow", "detailed": "broad", "narrow": "narrow", "broad": "broad"}
FETCH = {"narrow": (25, 4), "broad": (40, 10)}
MARKER_DENSITY = 1.0
SPARSE_BOOST = 2.5


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, with letters and white space as Unicode has them."""
    return c.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def question_breadth(q: Column) -> Column:
    q = F.lower(q)
    return F.when(any_of(q, NARROW), "narrow").when(any_of(q, BROAD), "broad").otherwise("narrow")


def needs_decomposition(q: Column) -> Column:
    return any_of(F.lower(q), COMPOUND)


def question_domain(q: Column) -> Column:
    return F.when(any_of(F.lower(q), LEGAL_QUESTION), "legal").otherwise("general")


def has_exact_reference(q: Column) -> Column:
    return q.rlike("(?iU)" + EXACT_REFERENCE)


def exact_reference(q: Column) -> Column:
    """The reference itself, for an exact search; null where there is none."""
    return F.nullif(F.regexp_extract(q, f"(?iU)({EXACT_REFERENCE})", 1), F.lit(""))


def marker_density(text: Column) -> Column:
    """Legal markers per thousand characters, of at least one thousand."""
    hits = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit("(?U)" + p)) for p in LEGAL_MARKERS])
    return hits / F.greatest(F.length(text) / 1000, F.lit(1.0))


def document_domain(text: Column, threshold: float = MARKER_DENSITY) -> Column:
    return F.when(marker_density(text) >= threshold, "legal").otherwise("general")


def sparse_weight(q: Column, weight: float, boost: float = SPARSE_BOOST) -> Column:
    return F.when(has_exact_reference(q), weight * boost).otherwise(F.lit(weight))


def fetch_sizes(breadth: Column) -> Column:
    """``fetch_k, top_k`` of a breadth."""
    broad, narrow = FETCH["broad"], FETCH["narrow"]
    return (
        F.when(breadth == "broad", F.struct(F.lit(broad[0]).alias("fetch_k"), F.lit(broad[1]).alias("top_k")))
        .otherwise(F.struct(F.lit(narrow[0]).alias("fetch_k"), F.lit(narrow[1]).alias("top_k")))
    )


def is_not_found(answer: Column) -> Column:
    low = F.lower(answer)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in NOT_FOUND])


def is_affirmative(verdict: Column) -> Column:
    return F.startswith(F.upper(F.trim(verdict)), F.lit("ДА"))


def condensed(question: Column, rewritten: Column) -> Column:
    return F.when(F.length(F.trim(rewritten)) < 3, question).otherwise(F.trim(rewritten))


def sub_questions(question: Column, answer: Column, most: int = 4) -> Column:
    """The lines of ``answer``; fewer than two leave the question as it is."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) < 2, F.array(question)).otherwise(F.slice(lines, 1, most))


def judge_score(raw: Column) -> Column:
    """The score of the first JSON object in a judge's answer, between 0 and 10; 0 where there is none."""
    found = F.get_json_object(F.regexp_extract(raw, r"(?s)\{[^{}]+\}", 0), "$.score")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(found.try_cast("double"), F.lit(0.0))))


def judge_reason(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(F.regexp_extract(raw, r"(?s)\{[^{}]+\}", 0), "$.reason"), F.lit(""))


def config_error(value: Column, value_type: Column, low: Column, high: Column, allowed: Column) -> Column:
    """Why a configuration value is not valid, or null: its type first, then the allowed values, then the limits."""
    number = value.try_cast("double")
    whole = value.rlike(r"^\s*[+-]?\d+\s*$")
    wrong = ((value_type == "bool") & ~F.lower(value).isin("true", "false")) | ((value_type == "int") & ~whole) | ((value_type == "float") & number.isNull())
    numeric = value_type.isin("int", "float")
    return (
        F.when(value.isNull() | wrong, "type").when(allowed.isNotNull() & ~F.array_contains(allowed, value), "allowed")
        .when(numeric & (number < low), "min").when(numeric & (number > high), "max")
    )


def chunk_error(content: Column, chunk_size: int, least: float = 0.3, most: float = 2.0) -> Column:
    size = F.length(content)
    blank = content.isNull() | (F.length(F.regexp_replace(content, r"(?U)\s+", "")) == 0)
    return F.when(blank, "empty").when(size < least * chunk_size, "too_short").when(size > most * chunk_size, "too_long")


def question_key(q: Column) -> Column:
    return F.sha2(F.trim(F.lower(q)), 256)


def scope_key(kind: Column, groups: Column) -> Column:
    """One key for everyone who sees the same documents: the order of the groups does not matter."""
    return F.sha2(F.concat(kind, F.lit(":["), F.array_join(F.array_sort(groups).cast("array<string>"), ", "), F.lit("]")), 256)


def system_prompt(base: str, breadth: Column, placeholder: str, rules: dict[str, str], legal: Column, legal_rules: str) -> Column:
    """``base`` with the breadth's rule in place of ``placeholder``, and the legal rules after it where the context is legal."""
    rule = F.when(breadth == "broad", rules["broad"]).otherwise(rules["narrow"])
    text = F.replace(F.lit(base), F.lit(placeholder), rule)
    return F.when(legal, F.concat(F.rtrim(text), F.lit("\n" + legal_rules))).otherwise(text)


def page_advice(total: Column, bad: Column, scans: Column, garbled: Column, first_bad: Column, last_bad: Column) -> Column:
    """What to do about a document's bad pages: none, ok, encoding, tail (a scanned end), pages, or reconvert."""
    share = bad / total
    tail = (first_bad >= last_bad - bad + 1) & (share <= 0.5)
    return (
        F.when(total == 0, "none").when(share <= 0.1, "ok").when((garbled > scans) & (garbled > 0), "encoding")
        .when(tail, "tail")
        .when(share <= 0.15, "pages")
        .otherwise("reconvert")
    )


def score_band(share: Column) -> Column:
    return F.when(share >= 0.7, "good").when(share >= 0.4, "fair").otherwise("poor")


# fixed value: what API keys begin with
KEY_PREFIX = "rg_sys_"


def storage_key(owner: Column, group: Column, document_id: Column, filename: Column) -> Column:
    """Where an uploaded file is kept: below its owner, else its group, else what is public; folders in the name are dropped."""
    name = F.concat(document_id.cast("string"), F.lit("_"), F.regexp_extract(filename, r"([^/]*)/*$", 1))
    user = F.concat(F.lit("uploads/users/"), owner.cast("string"), F.lit("/"), name)
    shared = F.concat(F.lit("uploads/groups/"), group.cast("string"), F.lit("/"), name)
    return F.when(owner.isNotNull(), user).when(group.isNotNull(), shared).otherwise(F.concat(F.lit("uploads/public/"), name))


def same_config(current: Column, stored: Column) -> Column:
    """Whether two configuration values are the same: as JSON where both are, whatever the spacing, the order of keys or how a number is written; else as text. Null equals null."""
    a, b = F.to_json(F.try_parse_json(current)), F.to_json(F.try_parse_json(stored))
    # a text that is no JSON stands for itself, as the stored JSON string of it does
    text = F.coalesce(F.get_json_object(F.concat(F.lit("["), stored, F.lit("]")), "$[0]"), stored)
    number = lambda j: F.when(j.rlike(r"^-?[0-9]"), j.try_cast("double"))
    same = (
        F.when(a.isNotNull() & b.isNotNull(), F.coalesce(a == b, F.lit(False)) | F.coalesce(number(a) == number(b), F.lit(False)))
        .otherwise(current == F.when(b.isNotNull(), text).otherwise(stored))
    )
    return F.when(current.isNull() | stored.isNull(), current.isNull() & stored.isNull()).otherwise(same)


def chat_role(role: Column) -> Column:
    """A stored message's role as a model's: the user's own is human, every other is the model's."""
    return F.when(role == "user", "human").otherwise("ai")


def key_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def key_display(raw: Column, prefix: str = KEY_PREFIX) -> Column:
    """What is shown of an API key: its prefix and six characters."""
    return F.substring(raw, 1, len(prefix) + 6)


def extraction_quality(total: Column, extracted: Column, garbled: Column, tables: Column, low: float = 0.3) -> Column:
    """``n_missing, n_garbled, bad_ratio, is_low`` of a document's pages; pages with tables do not count as garbled."""
    missing, odd = F.greatest(total - extracted, F.lit(0)), F.greatest(garbled - tables, F.lit(0))
    ratio = F.coalesce((missing + odd) / F.nullif(total, F.lit(0)), F.lit(0.0))
    return F.struct(missing.alias("n_missing"), odd.alias("n_garbled"), ratio.alias("bad_ratio"), ((total > 0) & (ratio > low)).alias("is_low"))
