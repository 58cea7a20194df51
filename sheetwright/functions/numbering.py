"""Number formats of lists and notes.

``label(value, format)`` is the plain function. ``column(value, format)`` is a
Spark column: formats by table, base or digit are expressions; those that
spell words or stack place values run the plain function in Arrow batches, once
for each distinct value of a batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and signs of the formats, in their order.
LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC_ALPHA = "أبتثجحخدذرزسشصضطظعغفقكلمنهوى"
ARABIC_ABJAD = "ابجدهوزحطيكلمنسعفصقرشتثخذضظغ"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"
THAI = "กขคงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรฤลฦวศษสหฬอฮ"
PERSIAN = "آبپتثجچحخدذرزژسشصضطظعـفقکگلمنوهی"
BULGARIAN = "абвгдежзиклмнопрстуфхцчшщъюя"
RUSSIAN = "абвгдежзиклмнопрстуфхцчшщыэюя"
SERBIAN = "абвгдђежзијклљмнњопрстћуфхцчџш"
UKRAINIAN = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
AIUEO_FULL = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"
AIUEO_HALF = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜｦﾝ"
IROHA_FULL = "イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセスン"
IROHA_HALF = "ｲﾛﾊﾆﾎﾍﾄﾁﾘﾇﾙｦﾜｶﾖﾀﾚｿﾂﾈﾅﾗﾑｳヰﾉｵｸﾔﾏｹﾌｺｴﾃｱｻｷﾕﾒﾐｼヱﾋﾓｾｽﾝ"
HANGUL_SYLLABLES = "가나다라마바사아자차카타파하"
HANGUL_JAMO = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
CIRCLED = "".join(map(chr, [*range(0x2460, 0x2474), *range(0x3251, 0x3260), *range(0x32B1, 0x32C0)]))
CIRCLED_JAMO = "".join(map(chr, range(0x3260, 0x326E)))
CIRCLED_SYLLABLES = "".join(map(chr, range(0x326E, 0x327C)))
GREEK_UPPER = "ΑΒΓΔΕϛΖΗΘΙΚΛΜΝΞΟΠϟΡΣΤΥΦΧΨΩϠ"
GREEK_LOWER = "αβγδεϛζηθικλμνξοπϟρστυφχψωϡ"
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
HAN_DIGITS, JAPANESE_LEGAL = "零一二三四五六七八九", "零壱弐参四伍六七八九"
FINANCIAL_SIMPLIFIED, FINANCIAL_TRADITIONAL = ("零壹贰叁肆伍陆柒捌玖", "拾佰仟万"), ("零壹貳參肆伍陸柒捌玖", "拾佰仟萬")
COUNTING_UNITS = "十百千萬"
CHICAGO = "*†‡§"
ROMAN_PLACES = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm"))
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
UNIT_ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred"))
HEBREW_VALUES = (("ת", 400), ("ש", 300), ("ר", 200), ("ק", 100), ("צ", 90), ("פ", 80), ("ע", 70), ("ס", 60), ("נ", 50), ("מ", 40), ("ל", 30), ("כ", 20), ("י", 10), ("ט", 9), ("ח", 8), ("ז", 7), ("ו", 6), ("ה", 5), ("ד", 4), ("ג", 3), ("ב", 2), ("א", 1))
BULLETS = "•◦▪"

# Formats by how they are built: (kind, alphabet, ...).
_ALPHABETS = {"Bulgarian": BULGARIAN, "Russian": RUSSIAN, "Serbian": SERBIAN, "Ukrainian": UKRAINIAN}
FORMATS: dict[str, tuple] = {
    "None": ("blank",),
    "Bullet": ("blank",),
    "Decimal": ("padded", 1),
    "DecimalZero": ("padded", 2),
    "DecimalZero3": ("padded", 3),
    "DecimalZero4": ("padded", 4),
    "DecimalZero5": ("padded", 5),
    "LowerLetter": ("repeated", LATIN, LATIN),
    "UpperLetter": ("repeated", LATIN.upper(), LATIN.upper()),
    "LowerAlphabetic": ("base", LATIN),
    "UpperAlphabetic": ("base", LATIN.upper()),
    "ArabicAlpha": ("base", ARABIC_ALPHA),
    "ArabicAbjad": ("base", ARABIC_ABJAD),
    "HebrewAlphabetic": ("base", HEBREW),
    "Thai": ("base", THAI),
    "Persian": ("base", PERSIAN),
    "LowerRoman": ("roman", False),
    "UpperRoman": ("roman", True),
    "CardinalText": ("spelled", False),
    "OrdinalText": ("spelled", True),
    "Ordinal": ("ordinal",),
    "OldHungarian": ("rovas",),
    "Chicago": ("signs", CHICAGO, 116),
    "IdeographLegalTraditional": ("financial", *FINANCIAL_TRADITIONAL, 999_999, ""),
    "ChineseLegalSimplified": ("financial", *FINANCIAL_SIMPLIFIED, 99_999_999, None),
    "IdeographCounting": ("counting",),
    "TianGan": ("table", STEMS, False),
    "DiZi": ("table", BRANCHES, False),
    "KoreanDigital2": ("digits", HAN_DIGITS),
    "JapaneseLegal": ("digits", JAPANESE_LEGAL),
    "AiueoHalfWidth": ("table", AIUEO_HALF, True),
    "AiueoFullWidth": ("table", AIUEO_FULL, True),
    "IrohaHalfWidth": ("table", IROHA_HALF, True),
    "IrohaFullWidth": ("table", IROHA_FULL, True),
    "HangulSyllable": ("table", HANGUL_SYLLABLES, True),
    "HangulJamo": ("table", HANGUL_JAMO, True),
    "CircledNumber": ("table", CIRCLED, False),
    "HangulCircledJamo": ("table", CIRCLED_JAMO, True),
    "HangulCircledSyllable": ("table", CIRCLED_SYLLABLES, True),
    "GreekUpper": ("greek", GREEK_UPPER),
    "GreekLower": ("greek", GREEK_LOWER),
    "HebrewNumber": ("hebrew",),
}
for _name, _letters in _ALPHABETS.items():
    FORMATS[f"CyrillicLower{_name}"] = ("base", _letters)
    FORMATS[f"CyrillicUpper{_name}"] = ("capital", _letters)
    FORMATS[f"CyrillicLower{_name}Repeated"] = ("repeated", _letters, _letters)
    FORMATS[f"CyrillicUpper{_name}Repeated"] = ("repeated", _letters.upper(), _letters)


def _base(n: int, alphabet: str) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, len(alphabet))
        out = alphabet[k] + out
    return out


def _spell(n: int, ordinal: bool) -> str:
    if n < 20:
        return (UNIT_ORDINALS if ordinal else UNITS)[n]
    if n < 100:
        tens, units = TENS[n // 10 - 2], n % 10
        return f"{tens}-{_spell(units, ordinal)}" if units else tens[:-1] + "ieth" if ordinal else tens
    scale, name = next(s for s in SCALES if n >= s[0])
    head, rest = f"{_spell(n // scale, False)} {name}", n % scale
    return f"{head} {_spell(rest, ordinal)}" if rest else head + ("th" if ordinal else "")


def _places(n: int, digits: str, units: str, short_ten: bool = False) -> str:
    """Digits with the signs of their places; one nought for any gap."""
    if n >= 10_000:
        head, rest = _places(n // 10_000, digits, units, short_ten) + units[3], n % 10_000
        return head + (digits[0] if 0 < rest < 1000 else "") + (_places(rest, digits, units, short_ten) if rest else "")
    out, gap = "", False
    for place, sign in ((1000, units[2]), (100, units[1]), (10, units[0]), (1, "")):
        d = n // place % 10
        if d:
            bare = short_ten and place == 10 and d == 1
            out += (digits[0] if gap else "") + ("" if bare else digits[d]) + sign
        gap = d == 0 and bool(out)
    return out or digits[0]


def _by_place(n: int, sign) -> str:
    """The signs of the decimal digits of ``n`` other than 0; ``sign``: (place, digit) to text."""
    digits = str(n)
    return "".join(sign(len(digits) - 1 - k, int(d)) for k, d in enumerate(digits) if d != "0")


def _greek(n: int, table: str) -> str:
    signs = [x.replace("ϛ", table[19] + table[20]) for x in table]
    myriads = ((n // 10**8, "ΜΜ"), (n // 10**4 % 10**4, "Μ"), (n % 10**4, ""))
    return ".".join(mark + _by_place(g, lambda place, d: "͵" * (place > 2) + signs[9 * (place % 3) + d - 1]) for g, mark in myriads if g)


def _hebrew_letters(n: int) -> str:
    """Of 1 to 999: hundreds beyond 400 stack, and 15 and 16 avoid the letters of a name."""
    letter = {value: sign for sign, value in HEBREW_VALUES}
    hundreds, low = divmod(n, 100)
    high = letter[400] * (hundreds // 4) + letter.get(hundreds % 4 * 100, "")
    return high + (letter[9] + letter[low - 9] if low in (15, 16) else _by_place(low, lambda place, d: letter[d * 10**place]))


def _hebrew(n: int) -> str:
    """Groups of three digits, highest first; a group of nought is a word for the thousands before it."""
    groups = [n // 1000**k % 1000 for k in range(len(str(n)) // 3 + 1)]
    top = max(k for k, g in enumerate(groups) if g)
    parts = [_hebrew_letters(groups[top])]
    for k in range(top - 1, -1, -1):
        if not groups[k] and k == top - 1 and groups[top] == 1:
            parts = ["אלף"]
        else:
            parts.append(_hebrew_letters(groups[k]) if groups[k] else "אלפים" if k == 0 or groups[k - 1] else "אלפי")
    return " ".join(parts)


def _rovas(n: int) -> str:
    """Counts before the signs of thousands and hundreds, and repeated signs of 50, 10, 5 and 1 behind."""
    one, five, ten, fifty, hundred, thousand = (chr(0x10CFA + k) for k in range(6))
    grouped = ((n // 10**9, thousand * 3), (n // 10**6 % 1000, thousand * 2), (n // 1000 % 1000, thousand), (n // 100 % 10, hundred))
    counted = "".join((_rovas(count) if count > 1 else "") + sign for count, sign in grouped if count)
    units = {0: (five, one), 1: (fifty, ten)}
    return counted + _by_place(n % 100, lambda place, d: units[place][0] * (d // 5) + units[place][1] * (d % 5))


def label(value: int, name: str) -> str:
    """The number in the given format; unknown formats are decimal."""
    kind, *rest = FORMATS.get(name, ("padded", 1))
    plain = str(value)
    if kind == "blank":
        return ""
    if kind == "padded":
        return plain if value < 0 else plain.zfill(rest[0])
    if kind == "spelled":
        words = ("minus " if value < 0 else "") + _spell(abs(value), rest[0])
        return words[0].upper() + words[1:]
    if kind == "ordinal":
        n = abs(value)
        return plain + ("th" if 11 <= n % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th"))
    if kind == "signs":
        signs, most = rest
        return signs[(value - 1) % len(signs)] * ((value - 1) // len(signs) + 1) if 0 < value <= most else ""
    if kind == "financial":
        digits, units, most, beyond = rest
        return _places(value, digits, units) if 0 <= value <= most else plain if beyond is None else beyond
    if kind == "counting":
        return _places(value, HAN_DIGITS, COUNTING_UNITS, short_ten=True) if 1 <= value <= 99_999 else plain
    if value <= 0:
        return plain
    if kind == "base":
        return _base(value, rest[0])
    if kind == "capital":
        word = _base(value, rest[0])
        return word[0].upper() + word[1:]
    if kind == "repeated":
        firsts, others = rest
        k = (value - 1) % len(others)
        return firsts[k] + others[k] * ((value - 1) // len(others))
    if kind == "table":
        table, again = rest
        return table[(value - 1) % len(table)] if again or value <= len(table) else plain
    if kind == "digits":
        return "".join(rest[0][int(c)] for c in plain)
    if kind == "roman":
        word = "".join(ROMAN_PLACES[k][value // 10**k % 10] for k in (3, 2, 1, 0)) if value < 4000 else plain
        return word.upper() if rest[0] else word
    return {"greek": lambda: _greek(value, *rest), "hebrew": lambda: _hebrew(value), "rovas": lambda: _rovas(value)}[kind]()


def _first_of(n: Column, firsts: list[int]) -> Column:
    """The first number with as many letters as ``n``."""
    out = F.lit(firsts[0])
    for first in firsts[1:]:
        out = F.when(n >= first, F.lit(first)).otherwise(out)
    return out


def _batched(name: str):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        known = {v: label(int(v), name) for v in values.dropna().unique()}
        return values.map(known).astype(object).where(values.notna(), None)

    return run


def column(value: Column, name: str) -> Column:
    """The labels of an integer column; null stays null."""
    kind, *rest = FORMATS.get(name, ("padded", 1))
    n = value.cast("int")
    plain = n.cast("string")
    letters = lambda s: F.array(*map(F.lit, s))
    if kind == "blank":
        return F.when(n.isNotNull(), F.lit(""))
    if kind == "padded":
        return F.when((n < 0) | (F.length(plain) >= rest[0]), plain).otherwise(F.lpad(plain, rest[0], "0"))
    if kind == "ordinal":
        m = F.abs(n)
        return F.concat(plain, F.when((m % 100).between(11, 13), "th").when(m % 10 == 1, "st").when(m % 10 == 2, "nd").when(m % 10 == 3, "rd").otherwise("th"))
    if kind == "signs":
        signs, most = rest
        k = F.pmod(n - 1, F.lit(len(signs)))
        return F.when(n.isNull(), n.cast("string")).when(n.between(1, most), F.repeat(F.get(letters(signs), k), F.floor((n - 1) / len(signs)).cast("int") + 1)).otherwise("")
    if kind == "table":
        table, again = rest
        inside = n > 0 if again else n.between(1, len(table))
        return F.when(inside, F.get(letters(table), F.pmod(n - 1, F.lit(len(table))))).otherwise(plain)
    if kind == "repeated":
        firsts, others = rest
        k = F.pmod(n - 1, F.lit(len(others)))
        return F.when(n > 0, F.concat(F.get(letters(firsts), k), F.repeat(F.get(letters(others), k), F.floor((n - 1) / len(others)).cast("int")))).otherwise(plain)
    if kind == "digits":
        return F.when(n > 0, F.translate(plain, "0123456789", rest[0])).otherwise(plain)
    if kind == "roman":
        places = [F.get(letters(ROMAN_PLACES[k]), F.floor(n / 10**k).cast("int") % 10) for k in (3, 2, 1, 0)]
        word = F.concat(*places)
        return F.when(n.between(1, 3999), F.upper(word) if rest[0] else word).otherwise(plain)
    if kind in ("base", "capital"):
        size = len(rest[0])
        firsts = [(size**d - 1) // (size - 1) for d in range(1, 8 if size >= 22 else 9)]  # the first number of d letters; enough for 32 bits
        digits = [F.when(n >= first, F.get(letters(rest[0]), (F.floor((n - _first_of(n, firsts)) / size**d) % size).cast("int"))).otherwise("") for d, first in enumerate(firsts)]
        word = F.concat(*digits[::-1])
        if kind == "capital":
            word = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 16))
        return F.when(n > 0, word).otherwise(plain)
    return _batched(name)(n)
