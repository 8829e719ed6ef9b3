"""Product names: cleaning, reasons against a name, titles out of lines, and keys, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from korbwerk import constants as K

#: Case, word characters and boundaries by Unicode.
CASELESS = "(?iU)"
EDGES, OUTER = " ,;:|-–", " |•·;:"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def replaced(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, CASELESS + s[0], s[1]), steps, text)


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def trimmed(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def without_repeat(text: Column) -> Column:
    """A name whose words are there twice in a row, or begin with a repetition of up to six words, with these once."""

    def once(words: Column, low: Column) -> Column:
        n = F.size(words)
        half = (n / 2).cast("int")
        whole = F.when((n >= 2) & (n % 2 == 0) & (F.slice(low, F.lit(1), half) == F.slice(low, half + 1, half)), F.slice(words, F.lit(1), half))
        parts = [F.when((n >= 2 * h) & (F.slice(low, 1, h) == F.slice(low, h + 1, h)), F.concat(F.slice(words, 1, h), F.slice(words, F.lit(2 * h + 1), F.greatest(n, F.lit(1))))) for h in range(6, 0, -1)]
        return F.array_join(F.coalesce(whole, *parts, words), " ")

    return bound(F.split(text, " "), lambda words: bound(F.transform(words, lambda w: F.lower(w)), lambda low: once(words, low)))


def _after_navigation(text: Column) -> Column:
    marked = F.lower(text).rlike("|".join(K.NAVIGATION_MARKERS))
    shop = F.contains(F.lower(text), F.lit("filiale "))
    behind = F.regexp_replace(text, CASELESS + "^.*filiale ", "")
    cut = reduce(lambda t, m: F.regexp_replace(t, CASELESS + f"^.*{m}", ""), K.NAVIGATION_MARKERS, text)
    return F.when(marked, F.when(shop, F.btrim(behind)).otherwise(F.btrim(cut))).otherwise(text)


def clean_name(name: Column) -> Column:
    """A name without navigation, validity, loyalty and price suffixes, repetitions and a country before it."""
    # Each step reads its text more than once; bound, a text is worked out once, however many steps it has behind it.
    text = bound(trimmed(squeeze(F.coalesce(name, F.lit(""))), OUTER), _after_navigation)
    text = trimmed(squeeze(replaced(text, K.NAME_SUFFIXES)), EDGES)
    text = replaced(without_repeat(text), [(K.ORIGIN_PREFIX, ""), *K.KNOWN_NAMES])
    return F.left(trimmed(squeeze(text), EDGES), F.lit(K.LONGEST_NAME))


def name_issue(name: Column) -> Column:
    """Why a name can't be a product's, by the first rule that fits; null if it can."""

    def rules(text: Column, low: Column) -> Column:
        found = [F.when(F.length(text) < 2, K.NAME_MISSING), F.when(low.isin(*K.NO_NAMES), K.NAME_IS_HEADING)]
        found += [F.when(text.rlike(CASELESS + p), why) for p, why in K.NAME_ISSUES]
        found += [
            F.when(F.length(text) > K.LONGEST_PLAIN_NAME, K.NAME_TOO_LONG),
            F.when(low.rlike("|".join(K.NAVIGATION_MARKERS)), K.NAME_HAS_NAVIGATION),
            F.when(low.rlike("https?://"), K.NAME_IS_URL),
        ]
        return F.coalesce(*found)

    return bound(clean_name(name), lambda text: bound(F.lower(text), lambda low: rules(text, low)))


def display_name(brand: Column, name: Column) -> Column:
    """The cleaned name with its brand, unless that is in its first words already."""
    short = F.btrim(F.coalesce(brand, F.lit("")))

    def shown(text: Column) -> Column:
        low, b = F.lower(text), F.lower(short)
        has = (low == b) | F.startswith(low, F.concat(b, F.lit(" "))) | F.contains(F.substr(low, F.lit(1), F.greatest(F.length(b) + 8, F.lit(20))), b)
        return F.when((short == "") | has, text).otherwise(F.concat_ws(" ", short, text))

    return bound(clean_name(name), shown)


def offer_name(name: Column) -> Column:
    """A cleaned name without origin and class, materials and dangling words at its end."""
    return trimmed(replaced(clean_name(name), [(p, "") for p in K.NAME_TAILS]), " ,;-")


def without_origin(name: Column) -> Column:
    """A name without a country and a colon or dash before it."""
    countries = "|".join(K.COUNTRY_PREFIXES)

    def shortened(text: Column) -> Column:
        before = F.lower(F.substring_index(text, ":", 1))
        named = F.contains(text, F.lit(":")) & before.rlike(f"{countries}|ursprung")
        dashed = F.lower(text).rlike(f"^(?:{countries}) - ")
        cut = F.when(named, F.btrim(F.regexp_replace(text, r"^[^:]*:", ""))).otherwise(text)
        return F.when(dashed, F.btrim(F.regexp_replace(cut, CASELESS + f"^(?:{countries}) - ", ""))).otherwise(cut)

    return bound(F.btrim(F.coalesce(name, F.lit(""))), shortened)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def is_noise_line(line: Column) -> Column:
    low = F.lower(F.btrim(F.coalesce(line, F.lit(""))))
    starts = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in K.NOISE_BEGINNINGS])
    return (low == "") | low.isin(*K.NOISE_LINES) | starts


def bad_price_context(text: Column) -> Column:
    """Whether a price in this text is likely no offer's: dates, deposits, savings and bonuses."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda x: F.contains(low, F.lit(x))
    offer = has("*") | has("aktion")
    dated = low.rlike("|".join(K.BAD_PRICE_CONTEXT))
    return F.when(dated, ~(has("pfand") & offer)).otherwise((has("sparen") & ~offer) | has("bonus"))


def repaired(text: Column) -> Column:
    """Units that character recognition got wrong."""
    steps = ((r"\bI\s*kg\b", "1 kg"), (r"\bI\s*l\b", "1 l"), (r"\b(\d+(?:[,.]\d+)?)\s+mi\b", "$1 ml"))
    value = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("Ikg"), F.lit("1 kg")), F.lit("Ixg"), F.lit("1 kg"))
    return squeeze(replaced(value, steps))


def name_quality(name: Column) -> Column:
    """Points for words and letters, less for symbols, for a single word and for symbols in capitals."""
    text = F.coalesce(name, F.lit(""))
    words, letters = F.regexp_count(text, F.lit(r"[A-Za-zÄÖÜäöüß]{2,}")), _letters(text)
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s&/-]", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    shouting = (letters >= 6) & (capitals / F.greatest(letters, F.lit(1)) > 0.85) & (symbols > 0)
    return (words * 25 + F.least(letters, F.lit(70)) - symbols * 12 - F.when(words == 1, 18).otherwise(0) - F.when(shouting, 45).otherwise(0)).cast("double")


def strict_name(name: Column) -> Column:
    """Whether a name read by character recognition is fit to be shown."""
    from korbwerk.functions.text import fold

    def checked(text: Column) -> Column:
        folded = fold(F.lower(text))
        alpha = F.filter(F.regexp_extract_all(folded, F.lit("[a-z0-9äöüß]+"), F.lit(0)), lambda t: t.rlike("[a-zäöüß]"))
        telling = F.filter(alpha, lambda t: ~t.isin(*K.NOISE_WORDS))
        last = F.try_element_at(telling, F.lit(-1))
        clipped = ~last.isin(*K.SHORT_NAME_WORDS) & ((F.length(last) <= 2) | ((F.length(last) == 3) & (F.size(telling) > 1)))
        bad = folded.rlike("|".join(K.BAD_FRAGMENTS)) | folded.rlike(r"(?U)\b(?:straße|strasse|haftung|vorrat|internet|qr|payback)\b|\b\d{2,}\b") | text.rlike(r"[|=<>_]")
        lone = (F.size(telling) == 0) | ((F.size(telling) == 1) & (F.size(alpha) > 1))
        few = _letters(text) / F.greatest(F.length(text), F.lit(1)) < K.LEAST_LETTERS
        return F.length(text).between(4, 80) & name_issue(text).isNull() & ~bad & ~lone & ~F.coalesce(clipped, F.lit(True)) & ~few

    return bound(trimmed(clean_name(name), " -,:;.|/"), checked)


def plausible_word(name: Column) -> Column:
    """Whether a text has letters enough, and no price or quantity before them, to be a product's name."""
    low = F.btrim(F.lower(F.coalesce(name, F.lit(""))), F.lit(" .,:;-"))
    price = low.rlike(CASELESS + r"^(?:ab|je)?\s*\d+(?:[.,]\d+)?(?:€)?(?:\s*pro)?$|^\d+(?:[.,]\d+)?\s+(?:uvp|statt)\b|^(?:\d+\s*)?für$|^\d+(?:[.,–-]|\s*€)")
    return F.coalesce(name, F.lit("")).rlike(r"[A-Za-zÄÖÜäöüß]{2,}") & ~price & ~low.isin(*K.GENERIC_HEADERS, "ab", "je", "pro", "stück", "set", "packung", "vegan") & ~low.rlike("^(?:uvp|preis|sparen|bis zu|gültig |kw |nur online|online-shop)")


def title_of(text: Column) -> Column:
    """A block's title: its first lines, up to the first that tells of a package, a unit price or a property."""
    p = K.LAYOUT_PATTERNS
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        return bound(trimmed(F.lower(line), " .,:;-"), lambda low: taken(acc, line, low))

    def taken(acc: Column, line: Column, low: Column) -> Column:
        stop = line.rlike(CASELESS + "|".join(f"(?:{p[k]})" for k in ("quantity", "unit_price", "unit_price_label", "unit_price_slash"))) | reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in K.DESCRIPTOR_PREFIXES])
        passed = (low == "") | low.isin(*K.GENERIC_HEADERS) | line.rlike(r"^[–-]?\d+\s*%$|^\d{1,3}[.,]\d{2}$")
        skipped = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in K.SKIPPED_TITLE_LINES]) | (F.length(line) > K.LONGEST_TITLE_LINE)
        done = acc["done"] | (F.size(acc["title"]) >= K.TITLE_LINES)
        return F.when(done | passed, F.struct(done.alias("done"), acc["title"].alias("title"))).when(stop, F.struct(F.lit(True).alias("done"), acc["title"].alias("title"))).otherwise(F.struct(F.lit(False).alias("done"), F.when(skipped, acc["title"]).otherwise(F.array_append(acc["title"], line)).alias("title")))

    title = F.aggregate(lines, F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("title")), step, lambda acc: F.array_join(acc["title"], " "))
    joined = replaced(without_origin(title), [(r"^\s*oder\s+", ""), (r"([A-Za-zÄÖÜäöüß])-\s+([A-Za-zÄÖÜäöüß])", "$1$2")])
    return clean_name(joined)


def usable_title(line: Column) -> Column:
    """Whether a line can be a card's title: words enough, and no package, price, origin, heading or property."""

    def checked(value: Column) -> Column:
        low, plain = F.lower(value), repaired(value)
        bad = F.contains(value, F.lit("€")) | F.lower(plain).rlike(CASELESS + r"\b(?:1\s*kg|1\s*l|100\s*g)\b") | value.rlike(CASELESS + K.TITLE_QUANTITY) | plain.rlike(CASELESS + K.TITLE_UNIT_PRICE)
        bad |= low.isin(*K.TITLE_COUNTRIES, *K.TITLE_HEADERS, *K.TITLE_PACKS) | reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in K.TITLE_NOISE])
        bad |= low.rlike(CASELESS + K.TITLE_DESCRIBED) | reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in K.TITLE_ADVERTS])
        told = value.rlike("[A-Za-zÄÖÜäöüß]{4,}") & F.length(value).between(4, K.LONGEST_TITLE) & (_letters(value) / F.greatest(F.length(value), F.lit(1)) >= K.TITLE_SHARE)
        return told & ~bad & name_issue(value).isNull()

    return bound(trimmed(clean_name(line), " -,:;."), checked)


def title_part(line: Column) -> Column:
    """What of a line can be a title: without class, package and origin, and without fragments of a word at either end."""
    raw = F.regexp_replace(F.split(F.coalesce(line, F.lit("")), CASELESS + K.TITLE_ENDS, 2)[0], CASELESS + K.TITLE_ORIGIN, "")
    value = F.btrim(F.regexp_replace(trimmed(clean_name(raw), " -,:;."), r"^[A-ZÄÖÜ]{1,2}\s+[-_]+\s*", ""))
    return trimmed(F.regexp_replace(value, r"[,;]\s*[a-zäöüß]{1,2}$", ""), " -,:;.")


def collected_category(name: Column) -> Column:
    """The second taxonomy, of collected offers."""
    low = F.lower(name)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.coalesce(*[F.when(has(words), c) for c, words in K.COLLECTED_CATEGORIES.items()], F.lit(K.COLLECTED_ELSE))


def offer_quality(name: Column, price: Column, quantity: Column, unit: Column, unit_price: Column, confidence: Column) -> Column:
    """struct(accepted, score) of an offer by its name, price, package and the certainty of its extraction."""

    def judged(text: Column) -> Column:
        words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-zÄÖÜäöüß0-9][A-Za-zÄÖÜäöüß0-9'’+\-]{1,}"), F.lit(0)), lambda w: w.rlike("[A-Za-zÄÖÜäöüß]"))
        return bound(words, lambda w: bound(facts(text, w), lambda f: scored(text, w, f)))

    def facts(text: Column, words: Column) -> Column:
        """Whether the name can be none, and whether nothing else tells of the offer."""
        low = F.btrim(F.lower(text), F.lit(" .,:;-"))
        one = words[0]
        vague = (F.size(words) == 1) & ~low.isin(*K.SAFE_SINGLE_WORDS) & (F.length(one) < 5) & ~F.contains(one, F.lit("-")) & ~F.substr(one, F.lit(2)).rlike(r"\p{Lu}")
        no = name_issue(text).isNotNull() | low.isin(*K.DESCRIPTIVE_ONLY) | text.rlike(CASELESS + "|".join(f"(?:{p})" for p in K.ATTRIBUTE_ONLY)) | ~F.coalesce((price > 0) & (price <= K.MOST_PRICE), F.lit(False)) | (F.size(words) == 0) | vague
        bare = quantity.isNull() & unit_price.isNull() & (F.size(words) < 2) & (F.coalesce(confidence, F.lit(0.0)) < 0.9)
        return F.struct(no.alias("no"), bare.alias("bare"))

    def scored(text: Column, words: Column, f: Column) -> Column:
        no, bare = f["no"], f["bare"]
        pack = F.when((quantity > 0) & F.lower(unit).isin(*K.SCORED_UNITS), 0.22).when(unit_price > 0, 0.15).otherwise(0.0)
        telling = F.when((F.size(words) >= 2) | text.rlike(r"[-\d]"), 0.13).otherwise(0.07)
        sure = F.when(confidence >= 0.9, 0.15).when(confidence >= 0.75, 0.10).when(confidence >= 0.6, 0.05).otherwise(0.0)
        score = F.round(F.lit(0.5) + pack + telling + sure, 6)
        score = F.when(no, 0.0).when(bare, F.least(score, F.lit(0.69))).otherwise(F.least(score, F.lit(1.0)))
        return bound(score, lambda s: F.struct((~no & ~bare & (s >= 0.72)).alias("accepted"), s.alias("score")))

    return bound(clean_name(name), judged)
