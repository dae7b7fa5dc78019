"""Province and district of an address, business type of an industry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical province and the prefixes that stand for it.
PROVINCES = {
    "서울특별시": ["서울특별시", "서울"],
    "부산광역시": ["부산광역시", "부산"],
    "대구광역시": ["대구광역시", "대구"],
    "인천광역시": ["인천광역시", "인천"],
    "광주광역시": ["광주광역시", "광주"],
    "대전광역시": ["대전광역시", "대전"],
    "울산광역시": ["울산광역시", "울산"],
    "세종특별자치시": ["세종특별자치시", "세종"],
    "경기도": ["경기도", "경기"],
    "강원특별자치도": ["강원특별자치도", "강원도", "강원"],
    "충청북도": ["충청북도", "충북"],
    "충청남도": ["충청남도", "충남"],
    "전북특별자치도": ["전북특별자치도", "전라북도", "전북"],
    "전라남도": ["전라남도", "전남"],
    "경상북도": ["경상북도", "경북"],
    "경상남도": ["경상남도", "경남"],
    "제주특별자치도": ["제주특별자치도", "제주"],
}

# Business type and the words in an industry name that decide it,
# first match wins.
INDUSTRY_WORDS = {
    "음식점업": [
        "음식점", "한식", "중식", "일식", "양식", "분식", "치킨", "카페", "커피", "주점", "식당",
        "피자", "햄버거", "샌드위치", "베이커리",
    ],
    "도소매": [
        "소매", "슈퍼마켓", "편의점", "마트", "도매", "종합 소매", "빵류", "과자류", "육류", "문구",
        "화초", "식물", "주방용품", "가전", "의복", "상품",
    ],
    "제조업": ["제조", "생산", "공장", "제작", "인쇄", "제품"],
    "교육업": ["교육", "학원", "훈련"],
    "보건업": ["의원", "병원", "한의원", "치과", "약국", "보건", "의료", "클리닉"],
    "숙박업": ["숙박", "호텔", "모텔", "펜션", "욕탕업", "찜질방"],
    "서비스업": [
        "서비스", "미용", "세탁", "수리", "청소", "관리", "경비", "경호", "인테리어", "디자인", "복지", "사회",
    ],
    "부동산업": ["부동산", "임대", "중개", "대리", "빌딩"],
    "건설업": ["건설", "건축", "시공", "토목"],
    "운수/물류업": ["운수", "운송", "배송", "택배", "물류", "화물", "자동차 운송", "창고"],
    "문화/여가업": ["영화관", "극장", "공연", "오락", "체육", "레저"],
}
OTHER = "기타"

# Classes with one business type each, and the words in the
# middle class that decide for general businesses, first match wins.
CLASS_TYPES = {"요식업체": "음식점업", "가정집": "가정/주거"}
GENERAL_CLASS = "일반사업체"
GENERAL_WORDS = [
    ("제조업", ["공장", "제조"]),
    ("교육업", ["교육", "학원", "훈련"]),
    ("보건업", ["의료", "병원", "보건"]),
    ("숙박업", ["숙박", "호텔"]),
    ("도소매", ["판매", "유통", "마트", "상가"]),
    ("부동산업", ["빌딩", "부동산"]),
    ("서비스업", ["복지", "사회"]),
    ("운수/물류업", ["창고", "물류"]),
    ("서비스업", ["서비스"]),
]
OTHER_GENERAL = "기타사업체"


def _first_true(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _prefix(address: Column) -> Column:
    """The longest province prefix the address starts with."""
    spellings = sorted((p for ps in PROVINCES.values() for p in ps), key=len, reverse=True)
    cases = [(F.startswith(address, F.lit(p)), F.lit(p)) for p in spellings]
    return _first_true(cases, F.lit(None).cast("string"))


def province(address: Column) -> Column:
    trimmed = F.trim(address)
    cases = [
        (reduce(lambda a, b: a | b, [F.startswith(trimmed, F.lit(p)) for p in spellings]), F.lit(name))
        for name, spellings in PROVINCES.items()
    ]
    return _first_true(cases, F.lit(None).cast("string"))


def district(address: Column, compat: bool = False) -> Column:
    """First word after the province, cut at an opening bracket.

    ``compat`` removes the canonical province name only, so an abbreviated
    address yields the abbreviation itself.
    """
    trimmed = F.trim(address)
    prefix = _prefix(trimmed)
    if compat:
        rest = F.coalesce(F.replace(trimmed, province(trimmed), F.lit("")), trimmed)
    else:
        rest = F.coalesce(F.substr(trimmed, F.length(prefix) + 1), trimmed)
    words = F.split(F.trim(rest), r"\s+")
    first = F.nullif(F.element_at(words, 1), F.lit(""))
    return F.trim(F.element_at(F.split(first, r"\("), 1))


def business_type_of_industry(industry: Column) -> Column:
    name = F.trim(industry)
    cases = [(_has_any(name, words), F.lit(kind)) for kind, words in INDUSTRY_WORDS.items()]
    return F.when(name.isNotNull(), _first_true(cases, F.lit(OTHER)))


def business_type_of_class(major: Column, middle: Column) -> Column:
    top, mid = F.trim(major), F.coalesce(F.trim(middle), F.lit(""))
    general = _first_true([(_has_any(mid, w), F.lit(k)) for k, w in GENERAL_WORDS], F.lit(OTHER_GENERAL))
    cases = [(top == k, F.lit(v)) for k, v in CLASS_TYPES.items()] + [(top == GENERAL_CLASS, general)]
    return F.when(top.isNotNull(), _first_true(cases, F.lit(OTHER)))


def business_type(major: Column, middle: Column, industry: Column) -> Column:
    """The class decides; the words of the industry name fill the gaps."""
    return F.coalesce(business_type_of_class(major, middle), business_type_of_industry(industry))
