"""Text clean-up, tokens and in-row term counting.

Everything here works inside one row, so a corpus is tokenised where it is
read: no exchange is needed before the first aggregation over documents.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from primrose.functions.stopwords import STOP_WORDS

# ASCII punctuation in code-point order.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

# Markup removed before tags, tags, and what an entity looks like
# after its ampersand.
HIDDEN_MARKUP = (
    r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
    r"|<!--.*?-->|<!doctype[^>]*>"
)
TAG = r"<[^>]*>"

ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# All named characters, from Python's own table.
_NAMED = "\x01".join(f"{n[:-1]}\x02{c}" for n, c in html5.items() if n.endswith(";"))
_LATE = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))

WORD_OR_SYMBOLS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
TWO_LETTERS = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def none_to_null(text: Column) -> Column:
    """The literal text ``'None'`` read as SQL null."""
    return F.nullif(text, F.lit("None"))


def _character(name: Column) -> Column:
    """What the entity ``name`` stands for; null if there is no such entity.

    Numbers 128 to 159 mean that code page; numbers of no character become
    the replacement character.
    """
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x01"), F.lit("\x02"))
    number = F.when(
        name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)
    ).when(name.startswith("#"), F.substr(name, F.lit(2)))

    def numbered(code: Column) -> Column:
        utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return (
            F.when(code.between(128, 159), F.substr(F.lit(_LATE), (code - 127).cast("int"), F.lit(1)))
            .when(
                (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�")
            )
            .otherwise(F.decode(utf32, "UTF-32"))
        )

    return F.when(number.isNotNull(), let(number.cast("long"), numbered)).otherwise(
        F.try_element_at(named, name)
    )


def decoded_entities(text: Column) -> Column:
    """Named and numeric entities that end in a semicolon as characters.

    Each is read once, so an escaped ampersand starts no new entity; what is
    no entity stays as it is. Texts without an ampersand are not touched.
    """

    def read(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, ENTITY, 1)
        written = F.concat(F.lit("&"), piece)
        rest = F.substr(piece, F.length(name) + 2)
        return F.when(i == 0, piece).when(name == "", written).otherwise(
            F.coalesce(F.concat(_character(name), rest), written)
        )

    decoded = F.array_join(F.transform(F.split(text, "&"), read), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text: tags dropped without a separator, entities decoded, ends
    stripped, newline to space.

    Deviation: script and style text is dropped as well.
    """
    text = F.regexp_replace(html, HIDDEN_MARKUP, "")
    text = decoded_entities(F.regexp_replace(text, TAG, ""))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.replace(text, F.lit("\n"), F.lit(" "))


def simple_tokens(text: Column) -> Column:
    """Non-word characters (ASCII rule) to spaces, lower case, split at every
    single space; blank tokens are kept."""
    return F.split(F.lower(F.regexp_replace(text, r"\W", " ")), " ")


def raw_tokens(text: Column) -> Column:
    """Words and runs of symbols as they are written."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_SYMBOLS), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words and runs of symbols, lower case, without the tokens that occur
    inside the punctuation string.

    Deviation: a Unicode word rule in place of a Treebank tokeniser.
    """
    kept = F.filter(raw_tokens(text), lambda w: ~F.contains(F.lit(PUNCTUATION), w))
    return F.transform(kept, F.lower)


def _without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(STOP_WORDS))


def content_terms(text: Column) -> Column:
    """Lower-case words of two or more characters, stop words removed."""
    return _without_stop_words(
        F.regexp_extract_all(F.lower(text), F.lit(TWO_LETTERS), F.lit(0))
    )


def tfidf_tokens(text: Column) -> Column:
    """Lower-case words of two or more characters, stop words kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TWO_LETTERS), F.lit(0))


def ngram_words(text: Column) -> Column:
    """Lower-case ASCII words, stop words removed."""
    return _without_stop_words(
        F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
    )


def ngram_tokens(text: Column, low: int = 1, high: int = 2) -> Column:
    """Stop-word-free ASCII words and their runs of ``low`` .. ``high``."""
    def runs(w: Column, n: int) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        if n == 1:
            return w
        return F.transform(
            starts, lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")
        )

    return let(
        ngram_words(text), lambda w: F.concat(*[runs(w, n) for n in range(low, high + 1)])
    )


def adjacent_bigrams(tokens: Column) -> Column:
    """Neighbouring pairs as an array of ``struct<w1, w2>``."""
    return let(
        tokens,
        lambda w: F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda left, i: F.struct(left.alias("w1"), F.get(w, i + 1).alias("w2")),
        ),
    )


def bigram_length_filter(w1: Column, w2: Column, min_word_len: int = 3) -> Column:
    """Either word is longer than ``min_word_len`` characters."""
    return (F.length(w1) > min_word_len) | (F.length(w2) > min_word_len)


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, n>>`` of one token array, one entry per term.

    Sorting the array inside the row and cutting it where the value changes
    counts a document without an exchange: the result is unique per document.
    """
    none = F.array().cast("array<struct<term:string,n:bigint>>")

    def count(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda i, k: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(b, k + 1), size) - i).cast("long").alias("n"),
                ),
            ),
        )

    return let(
        F.sort_array(tokens),
        lambda s: F.when(F.size(s) > 0, count(s)).otherwise(none),
    )


def word_count(text: Column) -> Column:
    """Pieces between single spaces; empty text counts as one."""
    return F.size(F.split(text, " "))


def clip80(text: Column) -> Column:
    """Up to 80 characters as they are, longer text cut to 77 and dots."""
    return F.when(F.length(text) <= 80, text).otherwise(
        F.concat(F.substring(text, 1, 77), F.lit("..."))
    )
