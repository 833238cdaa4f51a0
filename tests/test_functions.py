"""Literal cases for text, tokens, rules and access."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import acl, policy, text, tokens
from lodestone.operators.tables import phrase


def apply(spark, f, *values):
    row = spark.range(1).select(f(*[F.lit(v) for v in values]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("speci-\nalized", "specialized"), ("a    b   c", "a b c"), ("para1\n\n\n\npara2", "para1\npara2"), ("a\t\tb", "a b"), ("word1   word2\n\n\n   word3", "word1 word2\n word3"),
        ("a\n---\nb", "a\n--b"), ("a\n***\nb", "a\nb"), ("a\n=====\nb", "a\nb"), ("a\n•••••\nb", "a\nb"), ("a\n~~~~~\nb", "a\nb"), ("Компа-\nния заключила дого-\nвор", "Компания заключила договор"), ("", ""), ("a b", "a b"),
    ],
)
def test_clean(spark, raw, want):
    assert apply(spark, text.clean_extracted, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("# Head\ntext", "Head\ntext"), ("![pic](u.png)", "image: pic"), ("[name](http://x) and **bold** `code` ~~s~~", "name and bold code s"), ("a &lt;b&gt; &amp;amp;", "a <b> &amp;")])
def test_markdown(spark, raw, want):
    got = apply(spark, text.strip_markdown, raw)
    assert got == want or (raw.startswith("!") and "pic" in got)


@pytest.mark.parametrize(("raw", "want"), [("Hello World", ["hello", "world"]), ("a x", []), ("", []), ("Постановление от 14.04.2026 года", ["постановление", "от", "14", "04", "2026", "года"])])
def test_tokens(spark, raw, want):
    assert apply(spark, tokens.tokenize_raw, raw) == want


def russian(word):
    if len(word) < 5:
        return word
    return next((word[: -len(s)] for s in sorted(tokens.RUSSIAN_ENDINGS, key=len, reverse=True) if word.endswith(s) and len(word) - len(s) >= 3), word)


def test_stems(spark):
    words = ["station", "kindness", "table", "ous", "nation", "маркировка", "маркировки", "дом", "документами", "ведомости", "статья", "яяяяя", "ключ", "abcd", "привычкиый", "x1", "éa"]
    latin = lambda w: next((w[: -len(s)] for s in tokens.LATIN_ENDINGS if w.endswith(s) and len(w) - len(s) >= 3), w)
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", tokens.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: latin(w) if w.isascii() else russian(w) if "а" <= w[0] <= "я" else w for w in words}


@pytest.mark.parametrize(("raw", "want"), [("a" * 6 + "@" * 4, False), ("a" * 5 + "@" * 5, True), ("", False), ("\x01" * 90, True), ("@@@|@@@---@@@", False)])
def test_garbled(spark, raw, want):
    assert apply(spark, text.is_garbled, raw) is want


@pytest.mark.parametrize(("raw", "want"), [("", "empty"), ("abc", "scan"), ("a" * 49, "scan"), ("a" * 50, "text"), ("\x01" * 90, "garbled")])
def test_page_class(spark, raw, want):
    assert apply(spark, text.page_class, raw) == want


def test_small_text_functions(spark):
    assert apply(spark, text.article_number, "см. Статья 12.3 далее") == "12.3" and apply(spark, text.article_number, "нет") is None
    assert apply(spark, text.date_in_name, "acts/2024-05-06_x.pdf") == "2024-05-06"
    assert apply(spark, text.base_name, "a/b/report.pdf") == "report.pdf" and apply(spark, text.base_name, "") == "unknown"
    assert apply(spark, lambda _: text.markdown_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))), 0) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert apply(spark, lambda c: text.highlighted(c, "Art. 5"), "see ART. 5 and art 5") == "see <mark>ART. 5</mark> and art 5"
    assert apply(spark, text.better_text, "abcd", "abcdefg") == "abcdefg" and apply(spark, text.better_text, "abcd", "abcdef") == "abcd"
    assert apply(spark, text.tabular_lines, "a\tb\tc\nx    y\nplain") == 2


@pytest.mark.parametrize(
    ("q", "want"),
    [("Где найти отчёт?", "narrow"), ("Что такое маркировка?", "narrow"), ("Расскажи про маркировку", "broad"), ("Объясни всё", "broad"), ("Как работает система?", "broad"), ("Какие условия поставки", "broad"), ("Какой срок?", "narrow"), ("Почему система медленная", "narrow"), ("привет", "narrow")],
)
def test_breadth(spark, q, want):
    assert apply(spark, policy.question_breadth, q) == want


def test_rules(spark):
    assert apply(spark, policy.needs_decomposition, "Сравни тариф А и тариф Б") and not apply(spark, policy.needs_decomposition, "Один вопрос")
    assert apply(spark, policy.question_domain, "Вправе ли он отказаться") == "legal" and apply(spark, policy.question_domain, "Погода") == "general"
    assert apply(spark, policy.has_exact_reference, "см. СТАТЬЯ 15") and apply(spark, policy.exact_reference, "что в п. 3") == "п. 3"
    assert apply(spark, policy.document_domain, "\nСтатья 1\n" + "x" * 500) == "legal" and apply(spark, policy.document_domain, "") == "general"
    assert apply(spark, policy.judge_score, 'ok {"score": 12, "reason": "r"}') == 10.0 and apply(spark, policy.judge_score, "none") == 0.0
    assert apply(spark, policy.judge_reason, '{"score": 1, "reason": "r"}') == "r"
    assert apply(spark, policy.is_not_found, "Информация НЕ НАЙДЕНА в документах.") and apply(spark, policy.is_affirmative, " да, верно")
    assert apply(spark, policy.condensed, "вопрос", " a ") == "вопрос"
    assert apply(spark, policy.sub_questions, "q", "a\n\n b \nc\nd\ne") == ["a", "b", "c", "d"] and apply(spark, policy.sub_questions, "q", "one") == ["q"]
    assert [apply(spark, lambda c: policy.chunk_error(c, 550), v) for v in ("", "  ", "ab", "x" * 2000, "x" * 300)] == ["empty", "empty", "too_short", "too_long", None]
    check = lambda *v: apply(spark, policy.config_error, *v, F.lit(None).cast("array<string>"))
    assert [check("x", "int", 0.0, 9.0), check("12", "int", 0.0, 9.0), check("-1", "float", 0.0, 9.0), check("true", "bool", 0.0, 1.0), check("5", "int", 0.0, 9.0)] == ["type", "max", "min", None, None]
    a, b = (apply(spark, lambda k, g=g: policy.scope_key(k, F.array(*map(F.lit, g))), "internal") for g in ([3, 1], [1, 3]))
    assert a == b and apply(spark, policy.question_key, " Что? ") == apply(spark, policy.question_key, "что?")
    assert apply(spark, lambda b: policy.system_prompt("1. x\nRULE\n", b, "RULE", {"broad": "long", "narrow": "short"}, F.lit(True), "law"), "broad") == "1. x\nlong\n\nlaw"


def test_phrases_have_borders(spark):
    found = lambda s, p: apply(spark, lambda c: phrase(c, p), s)
    assert found("Новая СТАТЬЯ 15.", "статья 15") and not found("статья 155", "статья 15") and not found("ab", "ab") and found("a.b(c)", "a.b(c)") and not found("axb(c)", "a.b(c)")


CASES = [
    ("internal_public", None, None, "internal", 1, [], None, True), ("internal_public", None, None, "client", 1, [], None, False), ("internal_group", None, 2, "internal", 1, [2], None, True),
    ("internal_group", None, 2, "internal", 1, [3], None, False), ("internal_group", None, 2, "client", 1, [2], None, False), ("internal_private", 1, None, "internal", 1, [], None, True),
    ("internal_private", 2, None, "internal", 1, [], "admin", False), ("client_private", 1, None, "client", 1, [], None, True), ("client_private", 2, None, "client", 1, [], None, False),
    ("client_private", 2, None, "internal", 1, [], "admin", True), ("client_private", 2, None, "internal", 1, [], "user", False), ("client_private", 1, None, "internal", 1, [], "user", True),
]


def test_access(spark):
    df = spark.createDataFrame(CASES, "visibility string, owner_id int, group_id int, kind string, user_id int, groups array<int>, role string, want boolean")
    seen = df.withColumn("got", acl.can_view(*[F.col(c) for c in ("visibility", "owner_id", "group_id", "kind", "user_id", "groups", "role")]))
    assert seen.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    # the filter admits nothing that the row rule does not
    for kind, role in (("internal", "admin"), ("internal", "user"), ("client", "user")):
        docs = df.withColumn("ok", acl.visible(kind, 1, [2], role=role)).withColumn("may", acl.can_view(F.col("visibility"), F.col("owner_id"), F.col("group_id"), F.lit(kind), F.lit(1), F.array(F.lit(2)), F.lit(role)))
        assert docs.filter("ok AND NOT may").count() == 0
        assert docs.withColumn("search", acl.visible("internal", 1, [2], for_list=False, role="admin")).filter("search AND visibility = 'client_private'").count() == 0
