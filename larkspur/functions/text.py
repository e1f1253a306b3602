"""Text normalisation of short posts, as column functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eyes and nose of emoticons, and contractions in their order.
EYES, NOSE = "[8:=;]", "['`\\-]?"
CONTRACTIONS = (
    ("won't", "will not"), ("can't", "can not"), ("i'm", "i am"), ("ain't", "is not"), ("(\\w+)'ll", "$1 will"), ("(\\w+)n't", "$1 not"),
    ("(\\w+)'ve", "$1 have"), ("(\\w+)'s", "$1 is"), ("(\\w+)'re", "$1 are"), ("(\\w+)'d", "$1 would"),
)

#: The patterns of posts and their tags, in order.
TAGS = (
    (r"(http://www\.|https://www\.|http://|https://|www\.)[A-Za-z0-9./\]+\[]*", " <url> "), (r"\[\[User(.*)\|", " <user> "), (r"@[^\s]+", " <user> "),
    (r"[-+]?[.\d]*[\d]+[:,.\d]*", " <number> "), ("<3", " <heart> "), (f"{EYES}{NOSE}[Dd)]", " <smile> "), (f"[(d]{NOSE}{EYES}", " <smile> "),
    (f"{EYES}{NOSE}p", " <lolface> "), (rf"{EYES}{NOSE}\(", " <sadface> "), (rf"\){NOSE}{EYES}", " <sadface> "), (rf"{EYES}{NOSE}[/|l*]", " <neutralface> "),
    ("/", " / "), ("[.?!:;,()*]+", " "),
)
#: The characters of play scripts, by their ids.
SPEECH = "\n !\"&'(),-.0123456789:;>?ABCDEFGHIJKLMNOPQRSTUVWXYZ[]abcdefghijklmnopqrstuvwxyz}"


def _all(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def tag_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"[-+]?[.\d]*[\d]+[:,.\d]*", " <number> ")


def tag_post(text: Column) -> Column:
    """Urls, users, emoticons, numbers, slashes, punctuation, hashtags, capitals and lengthened letters as tags, in this order."""
    text = _all(text, TAGS)
    return F.regexp_replace(tag_capitals(tag_hashtags(text)), r"(.)\1{2,}", "$1 <elong> ")


def plain_words(text: Column) -> Column:
    """Lower case, contractions written out, letters and tag brackets only."""
    text = F.translate(F.lower(text), "\n\t\b\r", "    ")
    return F.trim(F.regexp_replace(_all(text, CONTRACTIONS), "[^A-Za-z<>]+", " "))


def last_tokens(tokens: Column, size: int, pad: str = "") -> Column:
    """The last ``size`` tokens, padded on the left."""
    kept = F.slice(tokens, F.greatest(F.size(tokens) - size + 1, F.lit(1)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(kept), F.lit(0))), kept)


def _each(text: Column, pattern: str, to) -> Column:
    """Every match of the (total) pattern in turn, replaced by ``to``."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), to), "")


def tag_hashtags(text: Column) -> Column:
    """A tag in capitals as its lower-case word and a mark; any other cut before its capitals."""
    def to(part: Column) -> Column:
        body = F.substr(part, F.lit(2))
        words = F.array_join(F.regexp_extract_all(body, F.lit("([A-Z]+[^A-Z]*|[^A-Z]+)"), F.lit(1)), " ")
        loud = F.concat(F.lit(" <hashtag> "), F.lower(body), F.lit(" <allcaps> "))
        return F.when(~part.rlike(r"^#\S"), part).when(F.upper(body) == body, loud).otherwise(F.concat(F.lit(" <hashtag> "), F.lower(words)))

    return _each(text, r"(#\S+|[^#]+|#)", to)


def tag_capitals(text: Column) -> Column:
    """Runs of two or more characters other than small letters, digits and some marks, in lower case with a mark."""
    plain = r"a-z0-9()<>' `\-"
    return _each(text, rf"([^{plain}]{{2,}}|[{plain}]+|[^{plain}])", lambda part: F.when(part.rlike(rf"^[^{plain}]{{2,}}$"), F.concat(F.lower(part), F.lit(" <allcaps> "))).otherwise(part))


def char_ids(text: Column, alphabet: str) -> Column:
    """The place of each character in the alphabet; null where it isn't there."""
    chars = F.array(*[F.lit(c) for c in alphabet])
    return F.transform(F.split(text, ""), lambda c: F.nullif(F.array_position(chars, c), F.lit(0)) - 1)


def char_windows(text: Column, width: int, step: int | None = None) -> Column:
    """Stretches of ``width`` characters (x) and the character after each (y), in order: an array of (x, y).

    Stretches begin every ``step`` (``width``) characters and end before the text's last one, so a text of no more than
    ``width`` characters has none.  Null text: null.  The text is read once for x and once for y.
    """
    form = F.lit(f"(?s)(?=(.{{{width}}})(.)).{{1,{step or width}}}")
    return F.arrays_zip(F.regexp_extract_all(text, form, F.lit(1)).alias("x"), F.regexp_extract_all(text, form, F.lit(2)).alias("y"))
