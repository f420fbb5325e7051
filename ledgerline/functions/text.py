"""Text functions over columns; all run inside the JVM."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a transaction, and US state codes.
STOP_WORDS = "a an and at by for from in into of on or the to via with pos purchase debit credit card payment pmt transaction".split()
#: Other words for payroll, word pairs that say nothing, and months.
PAYROLL = "payrol payrll pyrll paycheck salary".split()
PAIRS = ("cash app", "los angelos")
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy".split()


def printable(text: Column) -> Column:
    """Only the characters from blank to tilde."""
    return F.regexp_replace(text, "[^\\x20-\\x7E]+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def bound(value: Column, of) -> Column:
    """``of(value)``, with ``value`` computed once however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def distinct_tokens(text: Column) -> Column:
    """Tokens once each, in the order of their first places."""
    return F.array_join(F.array_distinct(tokens(text)), " ")


def without_repeats(text: Column) -> Column:
    """Tokens without those that equal the one before."""
    words = tokens(text)
    return F.array_join(F.filter(words, lambda t, i: (i == 0) | (t != F.get(words, i - 1))), " ")


def split_capitals(text: Column) -> Column:
    """Tokens that begin with a capital, cut before each run of capitals that follows other characters."""
    cut = lambda t: F.when(t.rlike("^[A-Z]"), F.regexp_replace(t, "(?<=[^A-Z])(?=[A-Z])", " ")).otherwise(t)
    return F.array_join(F.transform(tokens(text), cut), " ")


#: Words after which a code stands, and the words that stand for what a token is.
CODE_WORDS = "conf confirmation auth code id ref".split()
CODE, DATE, CITY, FOUR, NUMBER, STATE, SILENT = "tokcode", "tokdate", "tokcity", "tokfour", "toknum", "tokstate", "no description"
_DAY = "^[0-9]{1,2}$"
_NUMERIC_DATE = "^(?:[0-9]{1,2}[-/][0-9]{1,2}(?:[-/][0-9]{2,4})?|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})$"
_MONTH = f"^(?:{MONTHS})[a-z]*$"


def _core(token: Column) -> Column:
    """A token in lower case without signs around it."""
    return F.regexp_replace(F.lower(token), "^[^a-z0-9]+|[^a-z0-9]+$", "")


def _digits_in(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "[^0-9]", ""))


def _plain_class(word: Column, cities: list[str]) -> Column:
    """What becomes of a run of letters."""
    n, none = F.length(word), F.array().cast("array<string>")
    one = lambda x: F.array(F.lit(x) if isinstance(x, str) else x)
    names = [c for c in cities if " " not in c]
    joined = F.filter(F.array(F.lit("payroll"), F.regexp_replace(word, "^payroll|payroll$", "")), lambda w: w != "")
    plain = F.when(n == 1, none).when(word.isin(STATES), one(STATE)).when(word.isin(names) if names else F.lit(False), one(CITY)).when(word.isin(PAYROLL), one("payroll"))
    return plain.when(word.startswith("payroll") | word.endswith("payroll"), joined).when(word.startswith("xxxx") & word.rlike("^x+$"), one(FOUR)).otherwise(one(word))  # a masked number


def _word_class(word: Column, cities: list[str]) -> Column:
    """What becomes of a run of letters and digits: an array of no, one or two words."""
    n, none = F.length(word), F.array().cast("array<string>")
    one = lambda x: F.array(F.lit(x) if isinstance(x, str) else x)
    digits = _digits_in(word)
    mixed = F.when((n == digits) & (n < 4), none).when((n == digits) & (n == 4), one(FOUR)).when((n == digits) | (digits >= 3) | (n >= 9), one(NUMBER)).when(n == 1, none).otherwise(one(word))
    return F.when(word.rlike("[0-9]"), mixed).otherwise(_plain_class(word, cities))


def _token_class(token: Column, cores: Column, i: Column, cities: list[str]) -> Column:
    """Words for token ``i``, given the cores of all tokens: codes and dates by what stands beside them."""
    at = lambda k: F.coalesce(F.get(cores, i + k), F.lit(""))  # noqa: E731  # null before the first and after the last
    core, before, earlier, after = at(0), F.when(i > 0, at(-1)).otherwise(""), F.when(i > 1, at(-2)).otherwise(""), at(1)
    is_day, is_month = lambda x: x.rlike(_DAY), lambda x: x.rlike(_MONTH)
    dated = lambda x, y: (is_month(x) & is_day(y)) | (is_day(x) & is_month(y))
    none = F.array().cast("array<string>")
    digit = core.rlike("[0-9]")
    out = F.when(core.isin(*CODE_WORDS) & (after != ""), none).when(before.isin(*CODE_WORDS) & (core != ""), F.array(F.lit(CODE)))
    out = out.when(F.lower(token).rlike(rf"^(?:{'|'.join(CODE_WORDS)})[:#]+[a-z0-9]"), F.array(F.lit(CODE)))
    out = out.when(digit & (F.length(core) >= 12) & core.rlike("^[a-z0-9_]+$") & (_digits_in(core) >= 5), F.array(F.lit(CODE)))
    out = out.when(digit & core.rlike(_NUMERIC_DATE), F.array(F.lit(DATE)))
    out = out.when(~digit & is_month(core) & (is_day(before) | is_day(after)), F.array(F.lit(DATE)))
    # the day beside a month, and a year after both
    out = out.when(digit & is_day(core) & (is_month(before) | is_month(after)), none).when(digit & core.rlike("^[0-9]{2,4}$") & dated(earlier, before), none)
    words = F.split(F.regexp_replace(F.lower(split_capitals(token)), "([0-9]{5,})", " $1 "), "[^a-z0-9]+")
    out = out.otherwise(F.flatten(F.transform(F.filter(words, lambda w: w != ""), lambda w: _word_class(w, cities))))
    # most tokens are words in lower case: of all these cases only those without a digit or a sign can be theirs
    word = F.when(core.isin(*CODE_WORDS) & (after != ""), none).when(before.isin(*CODE_WORDS), F.array(F.lit(CODE)))
    word = word.when(is_month(core) & (is_day(before) | is_day(after)), F.array(F.lit(DATE))).otherwise(_plain_class(token, cities))
    return F.when(token.rlike("^[a-z]+$"), word).otherwise(out)


def clean_for_ngrams(text: Column, cities: list[str] = ()) -> Column:
    """Descriptions for clustering by n-grams: each token is classed by its form and its neighbours, and codes, dates,
    cities, numbers and states become words of their own; short numbers, single letters and signs go, payroll and
    direct deposits take one spelling.

    ``cities``: names in lower case, of one or more words.  A text of which only stop words are left is SILENT."""
    classed = lambda every: bound(F.transform(every, _core), lambda cores: F.transform(every, lambda t, i: _token_class(t, cores, i, cities)))
    said = F.array_join(F.flatten(bound(tokens(text), classed)), " ")
    if several := [c for c in cities if " " in c]:
        said = F.regexp_replace(said, r"\b(?:" + "|".join(sorted(several, key=len, reverse=True)) + r")\b", CITY)
    said = F.regexp_replace(said, r"\b(?:direct|dir) (?:deposit|dep)\b", "dir dep")
    return F.when(F.size(F.filter(tokens(said), lambda w: ~w.isin(STOP_WORDS))) == 0, SILENT).otherwise(said)


def clean_for_clusters(text: Column, irrelevant: list[str] = STOP_WORDS) -> Column:
    """Distinct tokens without irrelevant words, without pairs that say nothing and without an "indn" tag and the name
    after it; the text itself where nothing but stop words remains."""
    tag = lambda w: _core(w) == "indn"
    named = lambda every: F.filter(every, lambda w, i: ~(tag(w) | w.rlike("^indn[#:]") | ((i > 0) & tag(F.coalesce(F.get(every, i - 1), F.lit(""))))))
    firsts = [F.struct(F.lit(x.split(" ")[0]).alias("a"), F.lit(x.split(" ")[1]).alias("b")) for x in PAIRS]
    pair = lambda a, b: F.coalesce(F.struct(a.alias("a"), b.alias("b")).isin(*firsts), F.lit(False))
    alone = lambda kept: F.filter(kept, lambda w, i: ~(pair(w, F.coalesce(F.get(kept, i + 1), F.lit(""))) | ((i > 0) & pair(F.coalesce(F.get(kept, i - 1), F.lit("")), w))))
    words = lambda of: F.array(*[F.lit(w) for w in of])

    def cleaned(text: Column) -> Column:
        kept = F.filter(bound(tokens(text), named), lambda w: ~w.isin(irrelevant))
        tagged = F.contains(F.lower(text), F.lit("indn"))
        # most texts hold neither a tag nor both words of a pair: their distinct tokens need no look at neighbours
        paired = lambda plain: functools.reduce(lambda a, b: a | b, [F.array_contains(plain, x.split(" ")[0]) & F.array_contains(plain, x.split(" ")[1]) for x in PAIRS])
        plain = F.array_except(F.split(text, "\\s+"), words(["", *irrelevant]))
        left = bound(plain, lambda plain: F.when(tagged | paired(plain), F.array_distinct(bound(kept, alone))).otherwise(plain))
        return bound(left, lambda left: F.when(F.size(F.array_except(left, words(STOP_WORDS))) == 0, text).otherwise(F.array_join(left, " ")))

    return bound(text, cleaned)


def clean_for_rules(text: Column) -> Column:
    """Lower case, letters, digits and stars, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(split_capitals(text)), "[^a-z0-9* ]+", " "), " +", " "))


#: Phrases of texts whose card is not the customer's own.
EXTERNAL = ("wire transfer deposit card", "wire transfer fee", "banking advance from", "payment to", "pymt to", " from ", "eb to", r"\bdbt [0-9]", r"\bpmt [0-9]", "check[0-9]")


def card_tails(text: Column) -> Column:
    """Last four digits of numbers said after "card", but not after "gift card" and not in texts that speak of money
    from or to elsewhere (EXTERNAL)."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(r"(?:gift )?card(?: ending)?(?: in)?[ #x*]*[0-9]{4,}"), F.lit(0))
    mine = ~low.rlike("|".join(EXTERNAL))
    return F.when(F.coalesce(mine, F.lit(False)), F.array_distinct(F.transform(F.filter(found, lambda m: ~m.startswith("gift")), lambda m: F.right(m, F.lit(4))))).otherwise(F.array().cast("array<string>"))


def category_text(value: Column) -> Column:
    """A category given as text, number, list or JSON list: lists joined by "/", numbers are Other, null stays."""
    v = F.trim(value)
    listed = F.array_join(F.filter(F.transform(F.from_json(v, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), "/")
    return F.when(v.rlike("^-?[0-9]+(\\.[0-9]+)?$"), "Other").when(v.startswith("["), listed).otherwise(v)


def standard_timestamp(value: Column) -> Column:
    """ISO texts of several shapes to one: a bare date ends its day, missing milliseconds are .999."""
    v = F.trim(value)
    return F.when(~F.contains(v, F.lit("T")), F.concat(v, F.lit("T23:59:59.999Z"))).when(v.rlike("\\.[0-9]+Z?$"), F.concat(F.regexp_replace(v, "Z$", ""), F.lit("Z"))).otherwise(F.concat(F.regexp_replace(v, "Z$", ""), F.lit(".999Z")))


def regex_label(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the last rule, in the order given, any of whose patterns matches; one alternation per label."""
    out = F.lit(None).cast("string")
    for label, patterns in rules:
        out = F.when(F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False)), label).otherwise(out)
    return out


def transaction_category(label: Column) -> Column:
    """0 to 6: other, payroll, benefit, transfer (not a fee), deposit, gig, loan."""
    low = F.lower(label)
    return F.when(low == "loan", 6).when(low == "gig", 5).when(low == "deposit", 4).when((low == "transfer"), 3).when(low == "benefit", 2).when(low == "payroll", 1).otherwise(0)


#: Phrases of sub-categories of transfers and deposits, of which later ones win, and of loans that are none.
OWN_ACCOUNT = [r"\bto\b.*\bchecking\b", r"\bfrom.*\bchecking\b", r"\bfrom.*\bchk\b", r"\bshare\b", r"\bround up\b", r"\bsave as you go\b", r"\bfrom.*\bsav", r"\bbank", r"\bcredit.*line.*transfer\b", r"\breverse.*monthly.*service.*charge\b"]
SERVICES = ((r"\bcash app\b", "Cash App"), (r"\bvenmo\b", "Venmo"), (r"\bpaypal\b", "Paypal"), (r"\bapple pay\b", "Apple Pay"), (r"\bzelle?\b", "Zelle"))
MOVED = r"\bdep|atm|transfer|xfer"
DEPOSITS = ((r"\b(?:cash|atm)\b", "Cash Deposit"), (r"\b(?:mobile|edeposit|online|remote)\b", "Mobile Deposit"), (r"\bcheck\b", "Check Deposit"))


def transfer_subcategory(text: Column, category: Column, services: tuple[tuple[str, str], ...] = SERVICES) -> Column:
    """Sub-category of a transfer (3) or deposit (4); later rules win; ``services``: (pattern, name) of payment services."""
    out = F.when(category == 3, "Other Transfer").when(category == 4, "Other Deposit")
    out = F.when(text.rlike("(?i)" + "|".join(OWN_ACCOUNT)) & category.isin(3, 4), "Balance Transfer").otherwise(out)
    for pattern, name in services:
        out = F.when((category == 3) & text.rlike("(?i)" + pattern), name).otherwise(out)
    for pattern, name in DEPOSITS:
        out = F.when((category == 4) & text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def deposit_method(subcategory: Column) -> Column:
    return F.when(subcategory.endswith("Deposit"), F.split_part(subcategory, F.lit(" "), F.lit(1))).when(subcategory.isNotNull(), "Transfer")


def corrected_label(label: Column, text: Column, type_: Column) -> Column:
    """Labels after keyword rules: no transfer that is a fee, return or refund other than of tax; no income on debits."""
    text = F.coalesce(text, F.lit(""))
    fee = text.rlike(r"(?i)\bdir\b|\bach\b|\bfee\b|\breturn\b") | (text.rlike(r"(?i)\brefund\b") & ~text.rlike(r"(?i)\btax\b"))
    return F.when((label == "transfer") & fee, "other").when(label.isin("payroll", "gig") & (type_ == "DEBIT"), "other").otherwise(label)


def predicted_label(label: Column, text: Column) -> Column:
    """A model's label: loans are for rules alone, so that a predicted one is a transfer, payroll or other by its words."""
    fee = text.rlike(r"(?i)\bdir\b|\bach\b|\bfee\b|\breturn\b") | (text.rlike(r"(?i)\brefund\b") & ~text.rlike(r"(?i)\btax\b"))
    loan = label == "loan"
    return F.when(loan & text.rlike("(?i)" + MOVED) & ~fee, "transfer").when(loan & text.rlike("(?i)payroll"), "payroll").when(loan, "other").otherwise(label)


def account_match(given: Column, numbers: Column) -> dict[str, Column]:
    """Whether an account number's first four, last four or all digits are among those of a list."""
    plain = lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+", "")).otherwise(x)
    g = plain(given)
    return {
        "first_four": F.exists(numbers, lambda n: F.left(plain(n), F.lit(4)) == F.left(g, F.lit(4))),
        "last_four": F.exists(numbers, lambda n: F.right(plain(n), F.lit(4)) == F.right(g, F.lit(4))),
        "exact": F.exists(numbers, lambda n: plain(n) == g),
    }


def name_tokens(name: Column) -> Column:
    """Words of a name without titles, initials and dots."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"\.|\b(?:mr|mrs|ms|dr|jr|sr)\b", " "), "\\s+"), lambda t: F.length(t) > 1)


def word_similarity(a: Column, b: Column) -> Column:
    """1 for words that sound alike, else one less the edit distance over the longer length."""
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(F.soundex(a) == F.soundex(b), F.greatest(ratio, F.lit(0.9))).otherwise(ratio)


def name_match(a: Column, b: Column) -> Column:
    """Mean over the words of ``a`` of the best similarity with a word of ``b``."""
    x, y = name_tokens(a), name_tokens(b)
    best = F.transform(x, lambda s: F.coalesce(F.array_max(F.transform(y, lambda t: word_similarity(s, t))), F.lit(0.0)))
    return F.round(F.when(F.size(x) > 0, F.aggregate(best, F.lit(0.0), lambda t, v: t + v) / F.size(x)).otherwise(F.lit(0.0)), 4)


def log_odds_score(p: Column, odds: float = 100.0, points: int = 850, double: float = 100.0) -> Column:
    """Points that rise by ``double`` when the odds of ``p`` double; truncated towards zero."""
    factor = double / math.log(2)
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return (F.lit(points - factor * math.log(odds)) + factor * F.log(q / (1 - q))).cast("int")
