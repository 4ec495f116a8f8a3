"""Quality rules: clean texts line by line, then reject texts that lose too much.

Everything is built from column functions: per line with the functions on arrays, so
that no text leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .frames import fresh

# What separates words (U+0020 and U+0009 to U+000D) and what counts as a symbol.
SEPARATORS = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Marks that, standing alone, part the entries of a menu or a breadcrumb.
MARKS = "[|>»›·•/]"
MENU_MARK = rf"(?:^|[\x20\x09-\x0D]){MARKS}+(?=[\x20\x09-\x0D]|$)"
# Words cried out: two or more exclamation or question marks at their end.
SHOUT = r"[!?]{2,}(?=[\x20\x09-\x0D]|$)"
# What ends or parts sentences.
SENTENCE_MARK = r"[.!?:;…。]"
# These and what does so in other scripts: Unicode's Sentence_Terminal, and colons and semicolons.
ANY_SENTENCE_MARK = (
    r"[.!?:;…。\u037E\u0589\u061B\u061D-\u061F\u06D4\u0700-\u0704\u07F9\u0837\u0839\u083D\u083E\u0964\u0965"
    r"\u0F0D-\u0F11\u104A\u104B\u1362\u1364-\u1368\u166E\u1735\u1736\u17D4-\u17D6\u1803\u1804\u1809\u1944\u1945"
    r"\u1AA8-\u1AAB\u1B5A-\u1B5B\u1B5E\u1B5F\u1C3B\u1C3C\u1C7E\u1C7F\u203C\u203D\u2047-\u2049\u2E2E\u2E3C"
    r"\uA4FF\uA60E\uA60F\uA6F3\uA6F4\uA6F6\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9\uAA5D-\uAA5F"
    r"\uAAF0\uAAF1\uABEB\uFE52\uFE54-\uFE57\uFF01\uFF0E\uFF1A\uFF1B\uFF1F\uFF61"
    r"\x{10A56}\x{10A57}\x{10F55}-\x{10F59}\x{11047}\x{11048}\x{110BE}-\x{110C1}\x{11141}-\x{11143}"
    r"\x{111C5}\x{111C6}\x{111CD}\x{111DE}\x{111DF}\x{11238}\x{11239}\x{1123B}\x{1123C}\x{112A9}"
    r"\x{1144B}\x{1144C}\x{115C2}\x{115C3}\x{115C9}-\x{115D7}\x{11641}\x{11642}\x{1173C}-\x{1173E}"
    r"\x{11944}\x{11946}\x{11A42}\x{11A43}\x{11A9B}\x{11A9C}\x{11C41}\x{11C42}\x{11EF7}\x{11EF8}"
    r"\x{16A6E}\x{16A6F}\x{16AF5}\x{16B37}\x{16B38}\x{16B44}\x{16E98}\x{1BC9F}\x{1DA88}]"
)
# Phrases of page furniture, in lower case: English, German, French, Spanish.
FURNITURE = (
    "cookie", "javascript", "all rights reserved", "terms of use", "terms of service",
    "privacy policy", "click here", "sign up", "log in", "subscribe", "newsletter",
    "skip to content", "skip to main content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "cliquez ici",
    "se connecter", "aller au contenu",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "haga clic", "iniciar sesión",
    "ir al contenido",
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; shares are of the words or characters of a line or text."""

    least_words: int = 50
    most_repeated_percent: int = 50
    # A line fails ...
    menu_percent: int = 15  # with this share of menu marks among its words
    symbol_percent: int = 12  # with this share of symbols among its characters
    shout_percent: int = 40  # with this share of shouted words
    open_words: int = 30  # without any sentence mark, from this many words on
    furniture_words: int = 12  # with a phrase of page furniture, up to this many words
    # A text is rejected once it loses more than this share of its words.
    most_lost_percent: int = 30


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` with a struct column ``quality`` added at the end.

    Its fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (words in three-word windows that occur twice or more in the text),
    ``base_failed``, ``lost_words`` (in failed lines), ``kept`` and ``clean_text``, the
    text without its failed lines. A line without words never fails.

    A null text counts as empty: no words, so ``base_failed``; its ``clean_text`` is null.
    Every row is judged alone, repeated rows alike. Should ``docs`` have a column
    ``quality``, in whatever case, the new one gets underscores in front.
    """
    words, lines, windows, ordered, flags, failing, counts, lost, out = fresh(
        docs, "words", "lines", "windows", "ordered", "flags", "failing", "counts", "lost", "quality"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    with_arrays = docs.withColumn(words, _words(text)).withColumn(
        lines, F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SEPARATORS)) != "")
    )
    # What a function applied to every element needs is a column of its own: computed once.
    with_windows = with_arrays.withColumn(windows, _windows(F.col(words))).withColumn(
        ordered, _ordered_if_repeated(F.col(windows))
    )
    counted = with_windows.withColumn(
        counts,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(F.col(ordered)).alias("n_repeat_words"),
        ),
    )
    judged = counted.withColumn(flags, _flags(text, F.col(f"{counts}.n_symbols"))).withColumn(
        failing, _failing_lines(F.col(flags), F.col(lines), rules)
    )
    n_words, n_repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    base_failed = (n_words < rules.least_words) | (
        100 * n_repeat > rules.most_repeated_percent * n_words
    )
    totals = judged.withColumn(
        lost,
        F.aggregate(failing, F.lit(0).cast("long"), lambda total, line: total + _n_words(line)),
    ).withColumn(failing, F.array_distinct(failing))
    clean = F.when(F.size(failing) == 0, F.col("text")).otherwise(
        F.array_join(
            F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(failing, line)), "\n"
        )
    )
    within = 100 * F.col(lost) <= rules.most_lost_percent * n_words
    quality = F.struct(
        f"{counts}.*",
        base_failed.alias("base_failed"),
        F.col(lost).alias("lost_words"),
        (~base_failed & within).alias("kept"),
        clean.alias("clean_text"),
    )
    # As the one element of an array that is exploded: else the optimizer would push a filter
    # on the result below, and compute all of the above again for each element of an array.
    return totals.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(quality)).alias(out))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def _n_words(line: Column) -> Column:
    """Words of a line that has one at least."""
    return (F.regexp_count(F.btrim(line, F.lit(SEPARATORS)), F.lit(WORD_BREAK)) + 1).cast("long")


def _windows(words: Column) -> Column:
    """A hash of every three-word window, in the order of the text."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(
        starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )


def _ordered_if_repeated(windows: Column) -> Column:
    """Windows with their places, equal ones as neighbours; null if none occurs twice."""
    numbered = F.transform(windows, lambda w, i: F.struct(w.alias("window"), i.alias("at")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(numbered))


def _repeated_words(ordered: Column) -> Column:
    """Words covered by windows that occur twice or more, each word once."""

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(x["window"] == F.get(ordered, i)["window"], F.lit(False))

    found = F.filter(ordered, lambda x, i: same(x, i + 1) | same(x, i - 1))
    places = F.array_sort(F.transform(found, lambda x: x["at"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        places,
        start,
        lambda s, at: F.struct(
            (s["total"] + F.least(at - s["last"], F.lit(3))).alias("total"), at.alias("last")
        ),
        lambda s: s["total"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def _flags(text: Column, n_symbols: Column) -> Column:
    """What a text has that a rule looks for, so that lines are only measured where needed."""
    cried = text.contains("!!") | text.contains("??") | text.contains("!?") | text.contains("?!")
    return F.struct(
        _has_phrase(F.lower(text)).alias("furnished"),
        text.rlike(MARKS).alias("marked"),
        cried.alias("cried"),
        (n_symbols > 0).alias("symbols"),
    )


def _failing_lines(flags: Column, lines: Column, rules: Rules) -> Column:
    """The lines that break a rule."""
    def fails(line: Column) -> Column:
        bare = F.btrim(line, F.lit(SEPARATORS))
        n = _n_words(line)
        navigation = flags["marked"] & (
            100 * F.regexp_count(bare, F.lit(MENU_MARK)) >= rules.menu_percent * n
        )
        shouted = flags["cried"] & (
            100 * F.regexp_count(bare, F.lit(SHOUT)) >= rules.shout_percent * n
        )
        long_enough = F.length(line) >= 2 * rules.open_words - 1  # characters, before words count
        left_open = long_enough & ~line.rlike(SENTENCE_MARK) & (n >= rules.open_words)
        left_open = left_open & ~line.rlike(ANY_SENTENCE_MARK)  # last: the slower test, for few lines
        symbols = flags["symbols"] & (
            100 * F.regexp_count(bare, F.lit(SYMBOL)) >= rules.symbol_percent * F.length(bare)
        )
        furniture = flags["furnished"] & (n <= rules.furniture_words) & _has_phrase(F.lower(line))
        return navigation | shouted | left_open | symbols | furniture

    return F.filter(lines, fails)


def _has_phrase(line: Column) -> Column:
    found = F.lit(False)
    for phrase in FURNITURE:
        found = found | line.contains(phrase)
    return found
