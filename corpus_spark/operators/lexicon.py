"""Labels and mentions from lexicons and gazetteers; the lists are always parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.functions.lists import once, parse_list

# Default word lists of the sentiment rule.
POSITIVE = ("good", "great", "thanks", "thank", "ok", "yes", "хорошо", "спасибо", "супер", "отлично", "да", "норм")
NEGATIVE = ("bad", "problem", "no", "not", "нет", "плохо", "проблема", "сложно", "дорого", "отказ", "штраф")
# Default themes in the order that settles ties.
THEMES = {
    "visa/legal": ("visa", "виза", "визу", "permit", "residence", "legal", "law", "document", "documents", "паспорт", "документ", "immigration", "border", "граница"),
    "work/income": ("work", "job", "income", "salary", "remote", "работа", "зарплата", "доход", "налог", "tax", "business", "freelance"),
    "climate/lifestyle": ("climate", "weather", "sea", "lifestyle", "warm", "климат", "погода", "море", "тепло", "жизнь"),
    "family/relationships": ("family", "children", "school", "wife", "husband", "relationship", "семья", "дети", "школа", "жена", "муж", "родители"),
    "housing/location": ("rent", "apartment", "condo", "housing", "location", "area", "аренда", "квартира", "дом", "район", "жилье", "локация"),
    "safety/politics": ("safe", "safety", "politics", "war", "mobilization", "sanction", "безопасно", "безопасность", "политика", "война", "мобилизация", "санкции"),
    "adaptation/problems": ("problem", "issue", "hard", "difficult", "adapt", "language barrier", "проблема", "сложно", "трудно", "адаптация", "барьер", "ошибка"),
    "tourism/temporary stay": ("tourist", "tourism", "temporary", "vacation", "holiday", "trip", "турист", "туризм", "временно", "отпуск", "поездка", "зимовка"),
}
THEME_DEFAULT = "adaptation/problems"
# Default perceptions, matched as parts of words.
PERCEPTIONS = {
    "affordability": ("cheap", "expensive", "price", "cost", "rent", "дешев", "дорог", "цена", "стоимость"),
    "safety": ("safe", "danger", "crime", "police", "безопас", "опасно", "полиция"),
    "infrastructure": ("school", "hospital", "internet", "mall", "road", "школ", "больниц", "интернет", "дорог"),
    "mobility": ("traffic", "bts", "mrt", "taxi", "bike", "bus", "пробк", "такси", "байк", "транспорт"),
    "climate": ("climate", "weather", "rain", "heat", "sea", "климат", "погода", "дожд", "жара", "море"),
    "community": ("community", "friends", "russian", "expat", "чат", "комьюнити", "друз", "русск"),
    "bureaucracy/legal": ("visa", "permit", "immigration", "documents", "виза", "документ", "иммиграц"),
    "housing": ("condo", "apartment", "house", "landlord", "deposit", "кондо", "квартир", "дом", "залог"),
    "tourism/temporary stay": ("tourist", "hotel", "vacation", "trip", "турист", "отель", "отпуск", "поездк"),
    "adaptation problems": ("problem", "difficult", "language", "scam", "проблем", "сложно", "язык", "обман"),
}
PERCEPTION_DEFAULT = "adaptation problems"

def _layers(terms: Sequence[str]) -> list[list[str]]:
    """The terms, in lower case, so dealt that no term of a layer begins with another one of it."""
    layers: list[list[str]] = []
    for term in sorted({t.lower() for t in terms}):
        for layer in layers:
            if not any(term.startswith(t) for t in layer):
                layer.append(term)
                break
        else:
            layers.append([term])
    return layers


def whole_words(text: Column, terms: Sequence[str]) -> Column:
    """The terms that stand in a text as whole words, in lower case, each once.

    One pass for each layer of terms, one as a rule: at every edge of a word at most one term of a layer
    can stand, and looking ahead lets terms overlap.
    """
    layers = _layers(terms)
    if not layers:
        return F.array().cast("array<string>")
    passes = ["(?iU)(?<!\\w)(?=(" + "|".join("\\Q" + t + "\\E" for t in layer) + ")(?!\\w))" for layer in layers]
    every = lambda v: F.concat(*(F.regexp_extract_all(v, F.lit(p), F.lit(1)) for p in passes))
    return F.array_distinct(F.transform(once(text, every), lambda t: F.lower(t)))


def _first_best(scores: Sequence[Column], labels: Sequence[str], default: str) -> Column:
    """The label of the highest score, the first among equals; the default where none is above 0."""
    rows = [F.struct(s.alias("score"), F.lit(-k).alias("ord"), F.lit(x).alias("label")) for k, (s, x) in enumerate(zip(scores, labels))]
    return F.array_max(F.array(F.struct(F.lit(0).alias("score"), F.lit(1).alias("ord"), F.lit(default).alias("label")), *rows))["label"]


def _among(terms: Sequence[str]) -> Column:
    return F.array(*(F.lit(t) for t in sorted({x.lower() for x in terms})))


#: Punctuation that is no part of a token at its ends.
_ENDS = ".,!?;:()[]{}\"'"


def sentiment(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """Which side has more distinct words among the tokens, in lower case and without punctuation at their ends."""
    # a word with white space or with punctuation at its ends is no token
    words = sorted({w for w in (*positive, *negative) if w and not w[0] in _ENDS and not w[-1] in _ENDS and w.split() == [w]})
    ends = "[" + "".join("\\" + c for c in _ENDS) + "]*"
    one = "(?U)(?<!\\S)" + ends + "(" + "|".join("\\Q" + w + "\\E" for w in words) + ")" + ends + "(?!\\S)"
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(one), F.lit(1))) if words else F.array().cast("array<string>")
    found = lambda t, words: F.size(F.array_intersect(t, F.array(*map(F.lit, words)).cast("array<string>")))
    side = F.sign(once(tokens, lambda t: found(t, positive) - found(t, negative))).cast("int")
    return F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), side + 2)


def theme(text: Column, themes: Mapping[str, Sequence[str]] = THEMES, default: str = THEME_DEFAULT) -> Column:
    """The label with most distinct terms found as whole words."""
    return once(whole_words(F.coalesce(text, F.lit("")), _all_terms(themes)), lambda f: _theme_among(f, themes, default))


def _all_terms(lists: Mapping[str, Sequence[str]]) -> list[str]:
    return [t for terms in lists.values() for t in terms]


def _theme_among(found: Column, themes: Mapping[str, Sequence[str]], default: str) -> Column:
    return once(found, lambda f: _first_best([F.size(F.array_intersect(f, _among(terms))) for terms in themes.values()], list(themes), default))


def perception(text: Column, labels: Mapping[str, Sequence[str]] = PERCEPTIONS, default: str = PERCEPTION_DEFAULT) -> Column:
    """The label with most terms found anywhere in the lower-case text."""
    score = lambda low, terms: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: _first_best([score(low, terms) for terms in labels.values()], list(labels), default))


def places(text: Column, gazetteer: Mapping[str, Sequence[str]]) -> Column:
    """All names with an alias in the text as whole words, in the gazetteer's order."""
    return _places_among(whole_words(T.collapse(F.lower(F.coalesce(text, F.lit("")))), _all_terms(gazetteer)), gazetteer)


def _places_among(found: Column, gazetteer: Mapping[str, Sequence[str]]) -> Column:
    known = [(name, aliases) for name, aliases in gazetteer.items() if aliases]
    if not known:
        return F.array().cast("array<string>")
    return once(found, lambda f: F.array_compact(F.array(*(F.when(F.arrays_overlap(f, _among(aliases)), F.lit(name)) for name, aliases in known))))


def gazetteer_frame(spark: SparkSession, meta: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """(toponym, type, parent_city), as small as the gazetteer."""
    return spark.createDataFrame([(k, *v) for k, v in meta.items()], "toponym string, type string, parent_city string")


def few(meta: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast if a count proves it small."""
    return F.broadcast(meta) if meta.count() <= rows else meta


def mentions(df: DataFrame, meta: DataFrame | None = None, column: str = "toponyms") -> DataFrame:
    """One row a mention; blank names go; type and parent_city from a gazetteer frame."""
    # outer, because Spark would move a size filter on what makes the list below everything else
    out = df.withColumn("toponym", F.explode_outer(column)).drop(column).filter(F.trim(F.coalesce("toponym", F.lit(""))) != "")
    return out if meta is None else out.join(few(meta), "toponym", "left")


def ensure_places(df: DataFrame, gazetteer: Mapping[str, Sequence[str]], text_columns: Sequence[str] = ("text", "clean_text", "comment")) -> DataFrame:
    """An existing toponyms column is read as a list; else names are extracted from the first text column there is."""
    if "toponyms" in df.columns:
        return df if dict(df.dtypes)["toponyms"].startswith("array") else df.withColumn("toponyms", parse_list(F.col("toponyms")))
    text = next((c for c in text_columns if c in df.columns), None)
    return df.withColumn("toponyms", F.array().cast("array<string>") if text is None else places(F.col(text), gazetteer))


def label_all(
    df: DataFrame, text: str, gazetteer: Mapping[str, Sequence[str]], compatibility: bool = True, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE,
    themes: Mapping[str, Sequence[str]] = THEMES, theme_default: str = THEME_DEFAULT, perceptions: Mapping[str, Sequence[str]] = PERCEPTIONS, perception_default: str = PERCEPTION_DEFAULT,
) -> DataFrame:
    """Cleaned text, language, sentiment, theme, places and perception in one narrow pass.

    The terms of themes and places are found together: clean text has no white space that place names would collapse.
    """
    low = df.withColumn("clean_text", T.clean_text(F.col(text), compatibility)).withColumn("low", F.lower("clean_text"))
    low = low.withColumn("found", whole_words(F.col("low"), [*_all_terms(themes), *_all_terms(gazetteer)]))
    return low.select(
        "*", T.language(F.col("clean_text")).alias("lang"), sentiment(F.col("low"), positive, negative).alias("sentiment"), _theme_among(F.col("found"), themes, theme_default).alias("theme"),
        _places_among(F.col("found"), gazetteer).alias("toponyms"), perception(F.col("low"), perceptions, perception_default).alias("place_perception"),
    ).drop("low", "found")


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    wanted = scope.strip().lower()
    return df if wanted in ("", "all") else df.filter(F.lower(F.trim(F.coalesce("source", F.lit("")))) == wanted)
