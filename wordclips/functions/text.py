"""Column expressions about words, texts and votes (P*)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_]"
NON_WORD_KEEP_APOSTROPHE = r"[^\p{L}\p{N}_']"
SENTENCE_END = r"""[.!?]["')\]]*$"""



def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- words -----------------------------------------------------------------

def clean_word(col, apostrophe: bool = False) -> Column:
    """Letters, digits and underscore only, lower case."""
    return F.lower(F.regexp_replace(_c(col), NON_WORD_KEEP_APOSTROPHE if apostrophe else NON_WORD, ""))


def norm_tokens(col) -> Column:
    """Words of a reference text, one per written token that has any letters."""
    return F.filter(F.transform(F.split(_c(col), r"\s+"), lambda t: clean_word(t)), lambda w: w != "")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """What letters beyond ASCII fold to by Unicode's compatibility decomposition: one letter each, or several."""
    one, into, more = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        letter = chr(code)
        if not unicodedata.decomposition(letter):
            continue
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(letter)
            into.append(plain)
        elif plain:
            more[letter] = plain
    return "".join(one), "".join(into), more


def ascii_fold(col) -> Column:
    """Accents, ligatures and styles taken off as Unicode decomposes them; whatever is still not ASCII is dropped."""
    one, into, more = _folds()
    plain = F.translate(_c(col), one, into)
    several = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(several, x), x)), "")
    return F.regexp_replace(F.when(plain.rlike(r"[^\x00-\x7F]"), spelt).otherwise(plain), r"[^\x00-\x7F]", "")


def ends_sentence(token) -> Column:
    return _c(token).rlike(SENTENCE_END)


def written_tokens(texts: DataFrame) -> DataFrame:
    """(text_id, k, raw, word, ends) per written token of ``texts`` (text_id, text)."""
    split = F.split(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""), "[ \\n\\t\\r]+")
    return texts.select("text_id", F.posexplode(split).alias("k", "raw")).select(
        "text_id", "k", "raw", clean_word("raw").alias("word"), ends_sentence("raw").alias("ends"))


def tokenize(texts: DataFrame) -> DataFrame:
    """(text_id, pos, word, ends); the last word of a text always ends.

    The whole split is one array of one row, so numbering needs no shuffle.
    """
    split = F.split(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""), "[ \\n\\t\\r]+")
    parts = F.filter(F.transform(split, lambda t: F.struct(
        clean_word(t).alias("word"), ends_sentence(t).alias("ends"))), lambda s: s["word"] != "")
    # A projection of its own, so that the array is made once per text.
    made = texts.select("text_id", parts.alias("parts"))
    marked = F.transform("parts", lambda s, i: F.struct(
        s["word"].alias("word"), (s["ends"] | (i == F.size("parts") - 1)).alias("ends")))
    return made.select("text_id", F.posexplode(marked).alias("pos", "s")) \
        .select("text_id", F.col("pos").cast("bigint").alias("pos"), "s.word", "s.ends")


# --- numbers said aloud -------------------------------------------------------

# English number names.
ONES = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
        "fifteen sixteen seventeen eighteen nineteen").split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
# Stems of the names of 10**6, 10**9, ... and the parts of later ones.
ILLION_STEMS = ("m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non")
ILLION_UNITS = ("", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem")
ILLION_TENS = ("dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint",
               "octogint", "nonagint")
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth",
            "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _names(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _below_hundred(n: Column) -> Column:
    ones, tens = _names(ONES), _names(TENS)
    ten, one = F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int"))
    return F.when(n < 20, F.array(F.get(ones, n.cast("int")))) \
        .when(n % 10 == 0, F.array(ten)).otherwise(F.array(ten, one))


def _below_thousand(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    head = F.array(F.get(_names(ONES), hundreds.cast("int")), F.lit("hundred"))
    return F.when(n < 100, _below_hundred(n)).when(rest == 0, head) \
        .otherwise(F.concat(head, F.array(F.lit("and")), _below_hundred(rest)))


def scale_names() -> list[str]:
    """Names of the powers of a thousand, from 1 (no name) to centillion."""
    stems = [*ILLION_STEMS, *(u + t for t in ILLION_TENS for u in ILLION_UNITS), "cent"]
    return ["", "thousand", *(s + "illion" for s in stems)]


def say_number(digits: Column) -> Column:
    """Words of a whole number written in digits: 1105 is one thousand one hundred and five.

    The digits are taken in groups of three, so any length will do; null beyond
    the last power of a thousand that has a name.
    """
    names = scale_names()
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    n = F.ceil(F.length(plain) / 3).cast("int")
    padded = F.lpad(plain, n * 3, "0")
    groups = F.transform(F.regexp_extract_all(padded, F.lit(r"(\d{3})"), F.lit(1)), lambda g: g.cast("int"))
    none = F.array().cast("array<string>")

    def said(group: Column, i: Column) -> Column:
        scaled = F.concat(_below_thousand(group), F.array(F.get(_names(names), n - 1 - i)))
        last = F.when((n > 1) & (group == 0), none) \
            .when((n > 1) & (group < 100), F.concat(F.array(F.lit("and")), _below_hundred(group))) \
            .otherwise(_below_thousand(group))
        return F.when(i == n - 1, last).when(group > 0, scaled).otherwise(none)

    return F.when(n <= len(names), F.flatten(F.transform(groups, said)))


def as_ordinal(words: Column) -> Column:
    """The words of a number as those of an ordinal: twenty two is twenty second."""
    last = F.element_at(words, -1)
    said = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", "ie"), F.lit("th"))) \
        .otherwise(F.concat(last, F.lit("th")))
    for name, ordinal in ORDINALS.items():
        said = F.when(last == name, F.lit(ordinal)).otherwise(said)
    return F.concat(F.slice(words, 1, F.size(words) - 1), F.array(said))


# --- durations, votes, edges ----------------------------------------------------

def duration_floor_ms(word, n_phones) -> Column:
    """Shortest believable clip of a word: 45 ms a phone, else by its letters."""
    return F.when(_c(n_phones) > 0, _c(n_phones) * 45) \
        .otherwise(F.greatest(F.lit(80), F.length(_c(word)) * 25)).cast("bigint")


def splice_floor_ms(n_phones, has_vowel) -> Column:
    """Shortest audible take of a piece: 50 ms a phone, 50 more for a vowel."""
    return (_c(n_phones) * 50 + F.when(_c(has_vowel), 50).otherwise(0)).cast("bigint")


VETO_SCORE = -2


def vote_weight(score) -> Column:
    """Each net vote doubles or halves the odds, held to [0.02, 8]."""
    s = _c(score)
    return F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(
        F.least(F.lit(8.0), F.greatest(F.lit(0.02), F.pow(F.lit(2.0), s))))


def vetoed(score) -> Column:
    return F.coalesce(_c(score) <= VETO_SCORE, F.lit(False))


def report_weight(n) -> Column:
    """A fifth as likely per report."""
    return F.pow(F.lit(0.2), F.coalesce(_c(n), F.lit(0)))


def edge_weight(start="start_ms", end="end_ms", prev_end="prev_end", next_start="next_start") -> Column:
    """Takes with air around them cut cleaner."""
    after = _c(next_start).isNull() | (_c(next_start) - _c(end) >= 100)
    before = _c(prev_end).isNull() | (_c(start) - _c(prev_end) >= 60)
    return F.when(after, 60.0).otherwise(1.0) * F.when(before, 10.0).otherwise(1.0)


def extract_window(last: Column, edited="edited", start="start_ms", end="end_ms",
                   prev_end="prev_end", next_start="next_start", bleed="bleed_risk") -> Column:
    """What is cut around a clip from its own and its neighbours' times (P10).

    A struct (start_ms, end_ms).  ``last`` marks the last clip of an output,
    which keeps a longer tail.
    """
    hand = _c(edited) == 1
    s, e, nxt = _c(start), _c(end), _c(next_start)
    lead = F.when(hand, 0).otherwise(50)
    begin = s - lead
    begin = F.when(_c(prev_end).isNotNull(), F.greatest(begin, _c(prev_end) + 50)).otherwise(begin)
    begin = F.greatest(F.lit(0), F.least(begin, s))
    butt = nxt.isNotNull() & (nxt <= e + 1)
    want = F.when(hand, e).otherwise(e + F.when(last, 450).otherwise(180))
    clear = F.when(_c(bleed), 160).otherwise(50)
    want = F.when(nxt.isNotNull(), F.least(want, F.greatest(e, nxt - clear))).otherwise(want)
    floor = F.when(butt | hand, e).otherwise(F.greatest(e, begin + 50))
    return F.struct(begin.cast("bigint").alias("start_ms"),
                    F.greatest(want, floor).cast("bigint").alias("end_ms"))


def clamp(col, lo: float, hi: float, default: float) -> Column:
    """A numeric option held to its range; missing or NaN is the default."""
    v = _c(col).try_cast("double")
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), F.nanvl(
        F.coalesce(v, F.lit(float(default))), F.lit(float(default)))))


# --- spellings and titles --------------------------------------------------------

# Endings an apostrophe is put back before, in the order tried.
CONTRACTION_ENDINGS = ("ve", "ll", "re", "d", "s", "m")

# British endings and their American ones, in the order tried.
BRITISH_ENDINGS = (("our", "or"), ("ise", "ize"), ("ised", "ized"), ("ising", "izing"),
                   ("isation", "ization"), ("yse", "yze"), ("ogue", "og"))

# British letters and their American ones, wherever they stand.
BRITISH_ANYWHERE = (("our", "or"), ("ise", "ize"), ("isa", "iza"), ("yse", "yze"), ("ogue", "og"),
                    ("aemi", "emi"), ("oeu", "eu"), ("tt", "t"), ("ll", "l"))

RE_ENDING = r"([bcdfghjklmnpqrstvwxz])re(s?)$"


def spelling_variants(word) -> Column:
    """Other spellings of a word, most likely first, as array<string>."""
    w = _c(word)
    n = F.length(w)

    def swap(old: str, new: str, longer_by: int) -> Column:
        return F.when(w.endswith(old) & (n > len(old) + longer_by),
                      F.concat(F.substring(w, F.lit(1), n - len(old)), F.lit(new)))

    tries = [F.when(w.endswith("nt") & (n > 3), F.concat(F.substring(w, F.lit(1), n - 1), F.lit("'t")))]
    tries += [swap(e, "'" + e, 0) for e in CONTRACTION_ENDINGS]
    tries += [swap(b, a, 1) for b, a in BRITISH_ENDINGS]
    tries.append(F.when(w.endswith("re") & (n > 4) & ~w.substr(n - 2, F.lit(1)).isin(*"aeiou"),
                        F.concat(F.substring(w, F.lit(1), n - 2), F.lit("er"))))
    return F.filter(F.array(*tries), lambda v: v.isNotNull())


def american_spellings(word) -> Column:
    """American spellings of a word, single changes first, then all at once."""
    w = _c(word)
    tries, every = [], w
    for british, american in BRITISH_ANYWHERE:
        tries.append(F.replace(w, F.lit(british), F.lit(american)))
        every = F.replace(every, F.lit(british), F.lit(american))
    tries.append(F.regexp_replace(w, RE_ENDING, "$1er$2"))
    tries.append(F.regexp_replace(every, RE_ENDING, "$1er$2"))
    return F.array_distinct(F.filter(F.array(*tries), lambda v: v != w))


# Number words written as digits, and words left out of titles.
TITLE_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5"}
TITLE_STOP_WORDS = ("the", "a", "poem", "kids", "poems", "stories", "with")


def norm_title(col, extra_stop_words: tuple[str, ...] = ()) -> Column:
    """A title cut down to what tells it apart."""
    t = F.element_at(F.split(F.coalesce(_c(col), F.lit("")), r"\|", 2), 1)
    t = F.element_at(F.split(t, r"\s[-–]\s", 2), 1)
    t = F.regexp_replace(F.lower(t), r"\(.*?\)", " ")
    t = F.regexp_replace(t, "[^a-z0-9 ]", " ")

    def number(w: Column) -> Column:
        out = w
        for name, digit in TITLE_NUMBERS.items():
            out = F.when(w == name, F.lit(digit)).otherwise(out)
        return out

    words = F.transform(F.split(F.trim(t), " +"), number)
    stop = TITLE_STOP_WORDS + tuple(extra_stop_words)
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*stop)), " ")
