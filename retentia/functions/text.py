"""Message cleansing, category names, prompts and model answers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retentia.schemas import RESPONSE_FIELDS

# Characters kept by the two cleansing steps.
KEEP_SENTENCE = r"[^가-힣a-zA-Z0-9\s.,!?]"
# White space as a text engine with full Unicode support sees it.
UNICODE_SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
KEEP_WORDS = rf"[^a-zA-Z0-9가-힣ㄱ-ㅎㅏ-ㅣ{UNICODE_SPACE}]"
WORD = r"[\p{L}\p{N}_]{2,}"

# Spellings of a category and the canonical name.
CANONICAL_CATEGORY = {
    "비용/계약 문제": "요금/계약 문제",
    "계약/비용 문제": "요금/계약 문제",
    "요금 문제": "요금/계약 문제",
    "계약 문제": "요금/계약 문제",
    "해충": "해충 문제",
    "제품 문제": "제품",
    "서비스": "서비스 품질",
    "서비스품질": "서비스 품질",
    "배송": "배송문제",
    "시스템 오류": "시스템/전산 오류",
    "전산 오류": "시스템/전산 오류",
    "운영": "운영 관리",
}

PROMPT = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n {instruction}\n\n### Input:\n {input}\n\n### Response:\n"
)


def clean_sentence(text: Column) -> Column:
    """Keeps Hangul syllables, ASCII letters, digits and ``. , ! ?``."""
    spaced = F.regexp_replace(F.regexp_replace(text, KEEP_SENTENCE, " "), r"\s+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def clean_words(text: Column) -> Column:
    """Also keeps single jamo, drops punctuation without leaving a gap."""
    kept = F.regexp_replace(F.regexp_replace(text, KEEP_WORDS, ""), rf"[{UNICODE_SPACE}]+", " ")
    return F.trim(kept)


def clean_for_model(text: Column) -> Column:
    """Both steps in the order a message passes them on its way to the model."""
    return clean_words(clean_sentence(text))


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a literal dictionary, null when the key is absent."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_category(name: Column) -> Column:
    return F.coalesce(lookup(CANONICAL_CATEGORY, name), name)


def keywords_in_text(keywords: Column, text: Column) -> Column:
    """Keywords the text really contains; null stays null."""
    return F.filter(keywords, lambda k: F.contains(text, k))


def json_object(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null unless it is valid JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def model_answer(text: Column) -> Column:
    """Model output parsed into the fixed answer layout; null when unusable."""
    return F.from_json(json_object(text), RESPONSE_FIELDS)


def confidence(logprobs: Column) -> Column:
    """Mean token log-probability moved to 0..1; null when there is none."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(logprobs)
    return F.when(F.size(logprobs) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean + 5) / 5)))


def mean_probability(logprobs: Column) -> Column:
    """The other confidence form: mean of the token probabilities."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    return F.when(F.size(logprobs) > 0, total / F.size(logprobs))


def prompt(
    text: Column, taxonomy: Column, instruction: str, answer: Column | None = None, *, training: bool = False
) -> Column:
    """Instruction, cleaned text, taxonomy and, for training, the answer."""
    before, rest = PROMPT.format(instruction=instruction, input="\0").split("\0")
    parts = [
        F.lit(before + "[Voice-of-Customer]: "), clean_words(text),
        F.lit("\n\n[Category Dict]\n"), taxonomy if training else F.trim(taxonomy),
        F.lit(rest if training else "\n" + rest),
    ]
    if answer is not None:
        parts.append(answer)
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def is_claim(flag: Column) -> Column:
    """Only the exact word counts; every other spelling means no claim."""
    return F.when(flag == "claim", 1).otherwise(0)
