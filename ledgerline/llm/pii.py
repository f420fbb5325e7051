"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are exact patterns with checks.  Further
spans come from candidates of two families: tokens with a digit or an at sign,
and wide ones (names, street addresses, spelled-out addresses, numbers in
groups, what follows the word password).  Labelers (regex; gazetteers of given
names, surnames and places; words before and after; shape) vote on each
candidate of their family; its votes are one integer.  For each family
expectation-maximisation over counts of these integers (bounded by 2**labelers,
whatever the number of rows) estimates the labelers' reliabilities and a
posterior for each; a logistic regression on the votes and on the candidate's
length, share of digits and the sign in front, trained on all counts, is the
final classifier.  Accepted candidates are added that touch no base span, wide
ones before tokens.

Texts are read once, by array functions on each row; counts are the only
shuffle.  The work on a text grows with its length (times the logarithm of its
candidates): places are running sums, what stands around a candidate comes from
the pieces between matches, and overlaps are found along sorted spans.  Null and
empty texts have no spans.  Repeated rows count once each.

The gazetteers (``Gazetteers``) may be read from a table.  After a word for a
password, letters count as a secret from four on: shorter runs are words of
prose.  Names and streets have at most four words after the first.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Base patterns with possessive steps and guards, so that no text makes them slow; each finds what its plain form finds.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order of spans that start together.
ADDED = ("secret", "account", "contact", "name", "address")
#: Tokens with a digit or an at sign, tried at token starts only.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Words before a token that speak for a kind.
SECRET_WORDS = "password|passwd|passphrase|pwd|token|secret|credential|credentials|apikey|api_key|api-key|access_key|private_key|auth|bearer|login"
ACCOUNT_WORDS = "account|acct|iban|bic|swift|ssn|passport|license|licence|tax|insurance|card|visa|mastercard|amex|member|customer|patient|id"
CONTACT_WORDS = "phone|tel|telephone|mobile|cell|fax|call|whatsapp|email|e-mail|mail|contact|address|skype|telegram"
#: Gazetteers, and names that are also common words.
GIVEN = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|Kenneth|George|Kevin|Brian|Edward|Peter|Maria|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Lisa|Nancy|Anna|Emma|Laura|Julia|Sophie|Alice|Helen|Claire|Grace|Rose|Hope|April|May|June|Will|Frank|Hans|Klaus|Petra|Ingrid|Pierre|Jean|Marie|Luis|Carlos|Jose|Juan|Ana|Sofia|Ahmed|Mohammed|Fatima|Ali|Wei|Yuki|Hiroshi|Olga|Ivan|Priya|Raj"
SURNAMES = "Smith|Johnson|Williams|Brown|Jones|Garcia|Miller|Davis|Rodriguez|Martinez|Hernandez|Lopez|Gonzalez|Wilson|Anderson|Taylor|Moore|Jackson|Martin|Lee|Thompson|White|Harris|Clark|Lewis|Robinson|Walker|Young|Allen|King|Wright|Scott|Hill|Green|Adams|Baker|Nelson|Campbell|Mitchell|Roberts|Schmidt|Schneider|Fischer|Weber|Meyer|Wagner|Becker|Dupont|Dubois|Moreau|Bernard|Rossi|Bianchi|Silva|Santos|Ivanov|Petrov|Kumar|Singh|Patel|Khan|Chen|Wang|Zhang|Nguyen|Kim|Tanaka|Sato"
COMMON = "Mark|Grace|Rose|Hope|April|May|June|Will|Frank|Ali|Jean"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Place|Terrace|Way"
PLACES = "London|Paris|Berlin|Madrid|Rome|Vienna|Dublin|Zurich|Amsterdam|Brussels|Munich|Hamburg|Boston|Chicago|Seattle|Denver|Dallas|Houston|Austin|Portland|Atlanta|Toronto|Sydney|Melbourne|Tokyo|Delhi|Mumbai|Moscow"
NAME_WORDS = "name|named|signed|contact|patient|customer|client|employee|author|dear|sincerely|regards|attn|attention|mr|mrs|ms|dr|prof"
#: What any wide candidate holds: two capitals with a blank or hyphen between, a number before a capital or a digit,
#: a spelled dot, or the end of a secret's word with its sign.  It keeps the wide pattern off most texts.
WIDE_GATE = r"[A-Z][a-z]*+\.?[\x20-][A-Z]|[0-9][a-zA-Z)]?\x20[A-Z0-9]|\x20[(\[]?dot|[dDeEtT][:=]"
#: Entries of the gazetteers at most: they become alternatives of patterns.
GAZETTEER_ENTRIES = 2_000


@dataclass(frozen=True)
class Gazetteers:
    """Alternatives of patterns: given names, surnames, given names that are common words too, street words, places."""

    given: str = GIVEN
    surname: str = SURNAMES
    common: str = COMMON
    street: str = STREETS
    place: str = PLACES

    @staticmethod
    def of(table: DataFrame) -> Gazetteers:
        """From rows (kind, word), kind being one of the fields above; kinds without rows keep their lists."""
        rows = table.where("kind is not null and trim(word) <> ''").select("kind", F.trim("word").alias("word")).distinct().limit(GAZETTEER_ENTRIES + 1).collect()
        if len(rows) > GAZETTEER_ENTRIES:
            raise ValueError(f"more than {GAZETTEER_ENTRIES} entries")
        if unknown := {r["kind"] for r in rows} - {f.name for f in fields(Gazetteers)}:
            raise ValueError(f"no such kinds: {', '.join(sorted(unknown))}")
        words: dict[str, list[str]] = {}
        for r in rows:
            words.setdefault(r["kind"], []).append(re.escape(r["word"]))
        return Gazetteers(**{k: "|".join(sorted(v, key=lambda w: (-len(w), w))) for k, v in words.items()})

    def wide(self) -> str:
        """Wide candidates: capitalised runs after a given name or a title, house number and street, spelled-out
        addresses, numbers in groups, letters after a word for a secret.  Every step is possessive or bounded."""
        titled = r"(?:Mr|Mrs|Ms|Dr|Prof)\b\.?\x20[A-Z][a-z]++(?:[\x20-][A-Z][a-z]++){0,3}+"
        person = rf"(?:{self.given})\b(?:\x20[A-Z]\.)?(?:[\x20-][A-Z][a-z]++){{1,4}}+"
        street = rf"[0-9]{{1,5}}[a-zA-Z]?\x20(?:[A-Z][a-z]++\x20){{1,4}}(?:{self.street})\b"
        grouped = r"\(?[0-9]{3}\)?\x20[0-9]{2,3}[\x20-][0-9]{4}(?![0-9])"
        spelled = r"[A-Za-z0-9._-]++\x20[(\[]?at[)\]]?\x20[A-Za-z0-9-]++(?:\x20[(\[]?dot[)\]]?\x20[A-Za-z0-9-]++)++"
        secret = r"(?:(?<=[:=])|(?<=[:=]\x20))(?<=(?i:password|passwd|passphrase|secret|pwd)[:=]\x20?)[^\x20\x09-\x0D0-9@]{4,}+(?![^\x20\x09-\x0D])"
        return rf"(?<![A-Za-z0-9])(?:(?=[A-Z])(?:{titled}|{person})|(?=[0-9(])(?:{street}|{grouped}))|(?<![^\x20\x09-\x0D])(?=[A-Za-z0-9._-]++\x20[(\[]?at[)\]]?\x20){spelled}|{secret}"


ACCEPT = 0.5


SPANS = "array<struct<start:int,end:int,token:string>>"
CONTEXTS = "array<struct<start:int,end:int,token:string,before:string,after:string>>"
#: Characters of a context that is cut: more than any word that is looked for there, and what follows it.
AROUND = 60


def running(values: Column, neutral: Column, join) -> Column:
    """What ``join`` makes of each value and all before it: as many rounds as the length has bits."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin((n - 1).cast("long"))) - 1)).otherwise(F.array().cast("array<int>"))

    def one(acc: Column, k: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), k).cast("int"), n)
        return F.zip_with(acc, F.concat(F.array_repeat(neutral, shift), F.slice(acc, F.lit(1), n - shift)), join)

    return F.aggregate(rounds, values, one)


def _matches(text: Column, pattern: str) -> Column:
    """Structs (gap, token, until): what stands before each match since the last one, the match, and where it ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("token"))
    return F.transform(steps, lambda x: F.struct(x["gap"].alias("gap"), x["token"].alias("token"), (F.length(x["gap"]) + F.coalesce(F.length(x["token"]), F.lit(0))).alias("n")))


def places(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping: structs of start, end (code points) and the matched text."""

    def of(m: Column) -> Column:
        until = running(F.transform(m, lambda x: x["n"]), F.lit(0), lambda a, b: a + b)
        spans = F.zip_with(m, until, lambda x, end: F.struct((end - F.length(x["token"])).alias("start"), end.alias("end"), x["token"].alias("token")))
        return F.slice(spans, F.lit(1), F.size(m) - 1)  # the last piece has no match

    return _bound(_matches(text, pattern), of)


def _bound(value: Column, of) -> Column:
    """``of(value)``, computing ``value`` once."""
    return F.transform(F.array(value), of)[0]


def in_context(text: Column, pattern: str) -> Column:
    """``places`` with up to AROUND characters before and after each match; the matches next to it count as context."""

    def of(m: Column) -> Column:
        until = running(F.transform(m, lambda x: x["n"]), F.lit(0), lambda a, b: a + b)

        def span(end: Column, i: Column) -> Column:
            here, after = m[i], m[i + 1]
            gap = F.right(here["gap"], F.lit(AROUND))
            before = F.when((F.length(here["gap"]) < AROUND) & (i > 0), F.concat(F.right(F.get(m, i - 1)["token"], F.lit(AROUND)), gap)).otherwise(gap)
            rest = F.substring(after["gap"], 1, AROUND)
            behind = F.when(F.length(rest) < AROUND, F.concat(rest, F.coalesce(F.substring(after["token"], 1, AROUND), F.lit("")))).otherwise(rest)
            return F.struct((end - F.length(here["token"])).alias("start"), end.alias("end"), here["token"].alias("token"), before.alias("before"), behind.alias("after"))

        return F.transform(F.slice(until, F.lit(1), F.size(m) - 1), span)

    return _bound(_matches(text, pattern), of)


def free_of(cands: Column, spans: Column) -> Column:
    """The candidates (start, end, votes, shape) that touch none of the spans (start, end); ordered by place."""
    item = lambda x, kind, votes, shape: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), votes.alias("votes"), shape.alias("shape"))
    merged = F.array_sort(F.concat(F.transform(spans, lambda b: item(b, 0, F.lit(0), F.lit(0))), F.transform(cands, lambda c: item(c, 1, c["votes"], c["shape"]))))

    def of(every: Column) -> Column:
        far = F.lit((1 << 31) - 1)
        reach = running(F.transform(every, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
        follows = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        rows = F.filter(F.arrays_zip(every.alias("x"), reach.alias("reach"), follows.alias("next")), lambda r: (r["x"]["kind"] == 1) & (r["reach"] <= r["x"]["start"]) & (r["next"] >= r["x"]["end"]))
        return F.transform(rows, lambda r: F.struct(r["x"]["start"].alias("start"), r["x"]["end"].alias("end"), r["x"]["votes"].alias("votes"), r["x"]["shape"].alias("shape")))

    return F.when((F.size(spans) == 0) | (F.size(cands) == 0), cands).otherwise(_bound(merged, of))


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the matches that pass its check; cheap tests keep the patterns off most texts."""
    none = F.array().cast(SPANS)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    count = lambda x: F.length(_digits(x["token"]))
    found = {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["token"].rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, lambda x: F.when(count(x).between(12, 19), luhn(_digits(x["token"]))).otherwise(F.lit(False))),
        "phone": (F.contains(text, F.lit("+")), PHONE, lambda x: count(x).between(9, 15)),
    }
    return {k: F.when(gate, F.filter(places(text, p), test) if test else places(text, p)).otherwise(none) for k, (gate, p, test) in found.items()}


#: Signs that may stand between a word and what it speaks for.
BETWEEN = " \"':=#.,("


def _before(before: Column, words: str) -> Column:
    """Whether one of the words stands before, with nothing but signs between."""
    return F.right(F.rtrim(before, F.lit(BETWEEN)), F.lit(24)).rlike(rf"(?i)(?:^|[^a-z])(?:{words})$")


def labelers(token: Column, before: Column) -> list[tuple[str, Column]]:
    """Votes on a candidate, given the token and what stands before it."""
    named = lambda words: _before(before, words) | token.rlike(rf"(?i)^[\"'(]?(?:{words})[=:]")
    return [
        ("secret_word", named(SECRET_WORDS)),
        ("account_word", named(ACCOUNT_WORDS)),
        ("contact_word", named(CONTACT_WORDS)),
        ("assigned", F.right(F.rtrim(before, F.lit(" \"'")), F.lit(1)).isin("=", ":") | token.rlike(r"^[A-Za-z_-]{2,}+[=:]")),
        ("hex", token.rlike(r"[0-9a-f]{12}") & token.rlike(r"[a-f][0-9]|[0-9][a-f]")),
        ("mixed", token.rlike(r"[A-Za-z][0-9]") & token.rlike(r"[0-9][A-Za-z]") & (F.length(token) >= 8)),
        ("iban", token.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")),
        ("ssn", token.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")),
        ("long_digits", token.rlike(r"[0-9]{9}")),
        ("phone_like", token.rlike(r"^\(?[0-9]{3}\)?[.-]?[0-9]{3}[.-][0-9]{4}(?![0-9])")),
        ("at", token.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]") | token.rlike(r"^@[A-Za-z0-9_]{3,30}")),
        ("plain", token.rlike(r"^[^0-9A-Za-z]*+[0-9]{1,4}(?:[.,][0-9]{1,3})*+[^0-9A-Za-z]*+$")),
        ("date", token.rlike(r"^[^0-9A-Za-z]*+[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}[^0-9A-Za-z]*+$") | token.rlike(r"^[0-9]{1,2}:[0-9]{2}")),
        ("link", token.rlike(r"(?i)https?://|www\.|\.html?")),
    ]


def wide_labelers(token: Column, before: Column, after: Column, names: Gazetteers) -> list[tuple[str, Column]]:
    """Votes on a wide candidate, given what stands around it."""
    named = token.rlike(r"^[A-Z][a-z]")
    return [
        ("given", token.rlike(rf"\b(?:{names.given})\b") & named),
        ("surname", token.rlike(rf"[\x20-](?:{names.surname})$") & named),
        ("title", token.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b")),
        ("name_word", _before(before, NAME_WORDS) & named),
        ("street", token.rlike(rf"^[0-9]{{1,5}}[a-zA-Z]?\x20.*\x20(?:{names.street})$")),
        ("place", after.rlike(rf"^[,\x20]{{1,2}}(?:(?:{names.place})\b|(?:[A-Z][a-z]+,?\x20)?(?:[A-Z]{{2}}\x20)?[0-9]{{5}}\b)")),
        ("spelled", token.rlike(r"\x20[(\[]?dot[)\]]?\x20")),
        ("after_secret", before.rlike(rf"(?i)(?:{SECRET_WORDS})[:=]\x20?$")),
        ("grouped", token.rlike(r"^[0-9() -]+$")),
        ("account_word", _before(before, ACCOUNT_WORDS)),
        ("contact_word", _before(before, CONTACT_WORDS)),
        ("common", token.rlike(rf"^(?:{names.common})\b")),
    ]


#: Rates of a vote on spans that are none and on real ones, to start with, where not (0.01, 0.3).
START = {"plain": (0.6, 0.02), "date": (0.1, 0.01), "link": (0.1, 0.02), "assigned": (0.1, 0.5), "mixed": (0.1, 0.4), "long_digits": (0.05, 0.3)}
START |= {"given": (0.1, 0.5), "title": (0.01, 0.5), "street": (0.01, 0.5), "spelled": (0.01, 0.5), "after_secret": (0.01, 0.5), "grouped": (0.05, 0.4), "common": (0.3, 0.03)}
NAMES = ("secret_word", "account_word", "contact_word", "assigned", "hex", "mixed", "iban", "ssn", "long_digits", "phone_like", "at", "plain", "date", "link")
WIDE_NAMES = ("given", "surname", "title", "name_word", "street", "place", "spelled", "after_secret", "grouped", "account_word", "contact_word", "common")
#: Steps of a candidate's length, its share of digits and the sign in front; a shape is one of each.
FACETS = (5, 5, 3)


def _shape(token: Column, before: Column) -> Column:
    n = F.length(token)
    length = F.when(n < 6, 0).when(n < 10, 1).when(n < 16, 2).when(n < 25, 3).otherwise(4)
    digits = F.floor(4 * F.length(_digits(token)) / F.greatest(n, F.lit(1))).cast("int")
    sign = F.when(before.rlike(r"[:=]\x20?$"), 1).when(before.rlike(r"[\"'(\[<]$"), 2).otherwise(0)
    return length + FACETS[0] * (digits + FACETS[1] * sign)


def _facets(shape: Column) -> list[Column]:
    """Whether a shape shows each step of each facet."""
    a, b, _ = FACETS
    parts = (shape % a, F.floor(shape / a).cast("int") % b, F.floor(shape / (a * b)).cast("int"))
    return [parts[k] == v for k, steps in enumerate(FACETS) for v in range(steps)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: Gazetteers = Gazetteers()) -> DataFrame:
    """(id, base kinds' spans, cands, wides): all that is needed of the texts; candidates are (start, end, votes, shape)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    none, pattern = F.array().cast(CONTEXTS), names.wide()
    found = F.when(F.col("text").rlike("[0-9@]"), in_context(F.col("text"), TOKEN)).otherwise(none)
    wide = F.when(F.col("text").rlike(WIDE_GATE) & F.col("text").rlike(pattern), in_context(F.col("text"), pattern)).otherwise(none)
    rows = rows.select("id", *[s.alias(k) for k, s in base_spans(F.col("text")).items()], found.alias("tokens"), wide.alias("wide"))

    def cand(x: Column, is_wide: bool) -> Column:
        token, before = x["token"], x["before"]
        own = wide_labelers(token, before, x["after"], names) if is_wide else labelers(token, before)
        votes = F.lit(0)
        for k, (_, vote) in enumerate(own):
            votes = votes + F.when(vote, F.lit(1 << k)).otherwise(F.lit(0))
        # without a name and sign in front and punctuation around
        front = r"^([\"'\[]*+)" if is_wide else r"^((?:[\"'(\[]*+[A-Za-z_-]{2,}+[=:])?+[^0-9A-Za-z@+]*+)"
        lead = F.length(F.regexp_extract(token, front, 1))
        tail = F.length(token) - F.length(F.rtrim(token, F.lit(".,;:!?\"')]}>#$%&*|")))
        return F.struct((x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), votes.alias("votes"), _shape(token, F.right(before, F.lit(2))).alias("shape"))

    bare = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k)
    kept = lambda name, is_wide: F.filter(F.transform(name, lambda x: cand(x, is_wide)), lambda c: c["end"] > c["start"])
    return rows.select("id", *[bare(k) for k in KINDS], kept("tokens", False).alias("cands"), kept("wide", True).alias("wides"))


def label_model(patterns: list[tuple[int, int]], names: tuple[str, ...], rounds: int = 80) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over (votes, count): the prior, and the rates of each labeler."""
    start = [START.get(name, (0.01, 0.3)) for name in names]
    rates, prior = list(start), 0.3
    total = sum(c for _, c in patterns)
    # the starting rates stay as pseudo-counts, so that a labeler without votes keeps its meaning
    weight = max(10.0, 0.05 * total)
    for _ in range(rounds):
        real, hits = 0.0, [[0.0, 0.0] for _ in names]
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for k, (low, high) in enumerate(rates):
                odds += math.log(high / low) if votes >> k & 1 else math.log((1 - high) / (1 - low))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            real += count * p
            for k, hit in enumerate(hits):
                if votes >> k & 1:
                    hit[0] += count * (1 - p)
                    hit[1] += count * p
        rates = [((h[0] + weight * s[0]) / (total - real + weight), (h[1] + weight * s[1]) / (real + weight)) for h, s in zip(hits, start)]
        prior = min(0.95, max(0.001, (real + 0.3 * weight) / (total + weight)))
    return prior, rates


def _voted(votes: Column, k: int) -> Column:
    return votes.bitwiseAND(F.lit(1 << k)) != 0


def classifier(scanned: DataFrame, cands: str, names: tuple[str, ...]):
    """The final classifier of a family: a function from a candidate to its log odds, or None without candidates."""
    counts = scanned.select(F.explode(cands).alias("c")).groupBy("c.votes", "c.shape").agg(F.count("*").alias("n"))
    counts = keep(counts, f"pii-{cands}")
    patterns = [(r["votes"], r["n"]) for r in counts.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()]
    if not patterns:
        return None
    prior, rates = label_model(patterns, names)
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (low, high) in enumerate(rates):
        odds = odds + F.when(_voted(F.col("votes"), k), math.log(high / low)).otherwise(math.log((1 - high) / (1 - low)))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    inputs = [_voted(F.col("votes"), k) for k in range(len(names))] + _facets(F.col("shape"))
    rows = counts.select("n", p.alias("p"), *[x.cast("double").alias(f"f{k}") for k, x in enumerate(inputs)])
    vectors = VectorAssembler(inputCols=[f"f{k}" for k in range(len(inputs))], outputCol="features").transform(rows)
    both = vectors.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("weight")))).alias("x")).select("features", "x.*")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(both)
    weights, intercept = [float(w) for w in model.coefficients], float(model.intercept)

    def margin(c: Column) -> Column:
        out = F.lit(intercept)
        for has, w in zip([_voted(c["votes"], k) for k in range(len(names))] + _facets(c["shape"]), weights):
            out = out + F.when(has, w).otherwise(0.0)
        return out

    return margin


def _kind(votes: Column) -> Column:
    has = lambda *names: F.lit(sum(1 << NAMES.index(m) for m in names)).bitwiseAND(votes) != 0
    return F.when(has("secret_word", "hex", "mixed"), "secret").when(has("at", "phone_like", "contact_word"), "contact").otherwise("account")


def _wide_kind(votes: Column) -> Column:
    has = lambda *names: F.lit(sum(1 << WIDE_NAMES.index(m) for m in names)).bitwiseAND(votes) != 0
    return F.when(has("street"), "address").when(has("spelled"), "contact").when(has("given", "title"), "name").when(has("after_secret"), "secret").when(has("account_word"), "account").otherwise("contact")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, names: Gazetteers = Gazetteers()) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and ``found``, the same as structs."""
    scanned = keep(scan(docs, id_col, text_col, names), "pii")
    least = math.log(accept / (1 - accept))
    token_odds, wide_odds = classifier(scanned, "cands", NAMES), classifier(scanned, "wides", WIDE_NAMES)
    order = {k: i for i, k in enumerate(KINDS + ADDED)}
    entry = lambda x, kind, rank: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), kind.alias("kind"))

    def of(k: str) -> Column:
        return F.transform(k, lambda x: entry(x, F.lit(k), F.lit(order[k])))

    base = F.array_sort(F.concat(*[of(k) for k in KINDS]))
    rows = scanned.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), "cands", "wides")
    good = lambda cands, margin: F.filter(cands, lambda c: margin(c) >= least) if margin else F.slice(cands, 1, 0)
    bare = lambda name: F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumn("wide", free_of(good("wides", wide_odds), bare("base")))
    rows = rows.withColumn("more", free_of(good("cands", token_odds), F.concat(bare("base"), bare("wide"))))
    rank = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(order[k])) for k in ADDED])
    named = lambda cands, kind: F.transform(cands, lambda c: entry(c, kind(c["votes"]), rank(kind(c["votes"]))))
    added = F.concat(named("more", _kind), named("wide", _wide_kind))
    rows = rows.withColumn("found", F.array_sort(F.concat("base", added)))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"), F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
