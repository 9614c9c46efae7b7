"""Column expressions on names, paths, messages and languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terminology codes of languages and the bibliographic ones they are shown as.
BIBLIOGRAPHIC = {"sqi": "alb", "hye": "arm", "eus": "baq", "mya": "bur", "zho": "chi", "ces": "cze", "nld": "dut", "fra": "fre", "kat": "geo", "deu": "ger", "ell": "gre", "isl": "ice", "mkd": "mac", "msa": "may", "mri": "mao", "fas": "per", "ron": "rum", "slk": "slo", "bod": "tib", "cym": "wel"}


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The path's folders from the top: 'a/b/c' gives a, a/b."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def under(folder: Column, root: Column) -> Column:
    """Is a folder the root or inside it, by whole segments."""
    return (folder == root) | F.startswith(folder, F.concat(root, F.lit("/")))


def wildcard(text: Column, pattern: str) -> Column:
    """* and ? stand for any characters and one; the rest, also a backslash, for itself; any case."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text.rlike(f"(?is)^{body}$")


def same_tail(a: Column, b: Column, depth: int) -> Column:
    """Are the last ``depth`` segments of two folders equal, in any case."""
    tail = lambda c: F.lower(F.array_join(F.slice(F.split(c, "/"), F.greatest(-F.size(F.split(c, "/")), F.lit(-depth)), depth), "/"))
    return tail(a) == tail(b)


def message_key(message: Column) -> Column:
    """Messages that differ in quoted parts and numbers only have one key."""
    return F.regexp_replace(F.regexp_replace(message, "'[^']*'|\"[^\"]*\"", "*"), "[0-9]+", "#")


def log_key(severity: Column, message: Column) -> Column:
    """Severity and message, the inside of quotes as *, each run of digits as #; an open quote swallows the rest."""
    closed = F.regexp_replace(message, "'[^']*'|\"[^\"]*\"", "\u0001")
    kinds = F.regexp_extract_all(message, F.lit("('[^']*'|\"[^\"]*\")"), F.lit(1))
    # one placeholder after the other gets its quotes back
    parts = F.split(closed, "\u0001")
    joined = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(""), lambda s, i: F.concat(s, F.element_at(parts, i), F.when(i <= F.size(kinds), F.concat(F.substring(F.get(kinds, i - 1), 1, 1), F.lit("*"), F.substring(F.get(kinds, i - 1), 1, 1))).otherwise("")))
    open_ = F.regexp_replace(joined, "^((?:[^'\"]|'\\*'|\"\\*\")*)(['\"])(?!\\*\\2).*$", "$1$2")
    return F.concat(severity.cast("string"), F.lit("|"), F.regexp_replace(open_, "\\p{Nd}+", "#"))


def plain_name(name: Column) -> Column:
    """Letters and digits of any script in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{Nd}]+", " "))


def group_key(paths: Column) -> Column:
    """A set's key from its members' paths, whatever their order and case."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.transform(paths, F.lower)), "\n"), 256), 1, 16)


def language_code(code: Column) -> Column:
    low = F.lower(F.trim(code))
    table = F.create_map(*[F.lit(x) for pair in BIBLIOGRAPHIC.items() for x in pair])
    return F.upper(F.when(low == "und", "").otherwise(F.coalesce(F.try_element_at(table, low), low)))


def csv_field(text: Column) -> Column:
    """Quoted if it has a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def folder_pair(a: Column, b: Column) -> Column:
    """Two folders without the tail that they share, in order."""
    ra, rb = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    least = F.least(F.size(ra), F.size(rb))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), least), lambda i: F.element_at(ra, i) == F.element_at(rb, i)), False)
    drop = F.when(differs > 0, differs - 1).otherwise(least).cast("int")
    cut = lambda r: F.array_join(F.reverse(F.slice(r, drop + 1, F.greatest(F.size(r) - drop, F.lit(0)))), "/")
    return F.array_sort(F.array(cut(ra), cut(rb)))


#: What copies and edits add to a name, what separates an edit's name, extensions of moving pictures, tokens of languages.
COPY_OR_EDIT = r"(?i)(\s*\(\d+\)|\s*-\s*copy(\s*\(\d+\))?|\s+copy|[\s_-]*\(?(original|edited)\)?)+$"
EDIT_SUFFIXES = ["_original", "-original", " (original)", "-edited", "_edited", " (edited)"]
ANIMATED = ["gif", "webp", "apng", "heics"]
PIXEL_BURST = r"(?i)^(\d+).*BURST(\d+)"
TIME_TAKEN = r"^(.*?)(?<!\d)((?:19|20)\d{2})(-?)(\d{2})\3(\d{2})[ _-]?(\d{2})([.:-]?)(\d{2})\7(\d{2})(\d{3})?\D*$"
NUMBERED = r"^(.*?)(\d{1,18})(\D*)$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def may_be_animated(path: Column) -> Column:
    return extension(path).isin(ANIMATED)


def original_and_edit(a: Column, b: Column) -> Column:
    """One name is the other's and what an edit adds to it, in any case."""
    x, y = F.lower(stem(a)), F.lower(stem(b))
    adds = lambda long, short: F.startswith(long, short) & F.substring(long, F.length(short) + 1, F.length(long)).isin(EDIT_SUFFIXES)
    return adds(x, y) | adds(y, x)


def shot(path: Column) -> Column:
    """(series, number, timed) that a file's name tells: burst, time taken (milliseconds), last number; null without a number."""
    name = F.regexp_replace(stem(path), COPY_OR_EDIT, "")
    got = lambda pattern, i: F.regexp_extract(name, pattern, i)
    burst = F.rlike(name, F.lit(PIXEL_BURST)) & (F.length(got(PIXEL_BURST, 1)) <= 18)
    at = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", got(TIME_TAKEN, 2), got(TIME_TAKEN, 4), got(TIME_TAKEN, 5)), F.concat_ws(":", got(TIME_TAKEN, 6), got(TIME_TAKEN, 8), got(TIME_TAKEN, 9))), F.lit("yyyy-MM-dd HH:mm:ss"))
    ms = F.unix_millis(at) + F.coalesce(got(TIME_TAKEN, 10).try_cast("long"), F.lit(0))
    told = lambda series, number, timed: F.struct(series.alias("series"), number.alias("number"), F.lit(timed).alias("timed"))
    by_burst = told(F.concat(F.lit("burst"), got(PIXEL_BURST, 2)), got(PIXEL_BURST, 1).try_cast("long"), False)
    by_time = told(F.concat(F.lower(got(TIME_TAKEN, 1)), F.lit("@")), ms, True)
    by_number = told(F.lower(F.concat(got(NUMBERED, 1), F.lit("#"), got(NUMBERED, 3))), got(NUMBERED, 2).try_cast("long"), False)
    return F.when(burst, by_burst).when(F.rlike(name, F.lit(TIME_TAKEN)) & at.isNotNull(), by_time).when(F.rlike(name, F.lit(NUMBERED)), by_number)


def crash_program(folder: Column) -> Column:
    """The program's name in a crash report's folder: "AppCrash_game.exe_1a2b_..." gives "game.exe"."""
    return F.when(F.rlike(folder, F.lit(r"(?i)^App[A-Za-z]*_.*?\.exe_")), F.regexp_extract(folder, r"(?i)^App[A-Za-z]*_(.*?\.exe)_", 1))


def tags_differ(a: Column, b: Column) -> Column:
    """Two lists of language tags are both known and not the same set; "?" tells nothing."""
    known = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: ~t.isin("", "?")))
    x, y = known(a), known(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0))


STRATEGIES = {"largest": "keep_largest", "longest": "keep_longest", "bestresolution": "keep_best_resolution", "highestquality": "keep_highest_quality"}


def strategy_name(text: str) -> str:
    """The strategy that a user means, in any spelling; raises ValueError for none."""
    plain = re.sub(r"[^a-z]", "", text.lower()).removeprefix("keep")
    if plain not in STRATEGIES:
        raise ValueError(f"no such strategy: {text!r}; one of {', '.join(STRATEGIES.values())}")
    return STRATEGIES[plain]


#: Separators of words in names, levels compared from the file up, and the words that name a language or a country.
NAME_SEPARATORS, NAME_LEVELS = r"[\s_.\-()\[\]{}]+", 4
LANGUAGE_WORDS = {
    "en": "en eng english", "de": "de ger deu german deutsch", "fr": "fr fre fra french francais français",
    "es": "es spa esp spanish espanol español castellano", "it": "it ita italian italiano", "ja": "ja jp jpn jap japanese",
    "ru": "ru rus russian", "pl": "pl pol polish polski", "pt": "pt por ptb portuguese portugues português brazilian",
    "nl": "nl dut nld dutch nederlands", "sv": "sv swe swedish svenska", "no": "no nb nor norwegian norsk", "da": "da dan danish dansk",
    "fi": "fi fin finnish suomi", "cs": "cs cz cze ces czech cesky", "hu": "hu hun hungarian magyar", "tr": "tr tur turkish",
    "ko": "ko kr kor korean", "zh": "zh cn tw chi zho chs cht chinese", "ar": "ar ara arabic", "el": "el gr gre ell greek",
    "he": "he heb hebrew", "uk": "ua ukr ukrainian", "ro": "ro rum ron romanian", "bg": "bg bul bulgarian", "hr": "hr hrv croatian",
    "sk": "sk slk slo slovak", "th": "th tha thai", "vi": "vi vie vietnamese",
    "us": "us", "gb": "gb uk", "au": "au", "ca": "ca", "at": "at", "ch": "ch", "be": "be", "br": "br", "mx": "mx latam", "hk": "hk",
}


def language_versions(a: Column, b: Column) -> Column:
    """Two paths name one film in two languages: where they first differ, from the file up, they differ in languages only."""
    codes = F.create_map(*[F.lit(x) for code, words in LANGUAGE_WORDS.items() for w in words.split() for x in (w, code)])

    def levels(path: Column) -> Column:
        parts = F.reverse(F.filter(F.split(F.lower(path), "/"), lambda p: p != ""))
        return F.slice(F.transform(parts, lambda p, i: F.when(i == 0, F.regexp_replace(p, r"\.[^.]*$", "")).otherwise(p)), 1, NAME_LEVELS)

    x, y = levels(a), levels(b)
    differing = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("x"), q.alias("y"))), lambda p: p["x"] != p["y"])
    first = F.get(differing, F.lit(0))
    words = lambda name: F.filter(F.split(name, NAME_SEPARATORS), lambda w: w != "")
    rest = lambda name: F.filter(words(name), lambda w: F.try_element_at(codes, w).isNull())
    told = lambda name: F.sort_array(F.array_distinct(F.filter(F.transform(words(name), lambda w: F.try_element_at(codes, w)), lambda c: c.isNotNull())))
    differ = (rest(first["x"]) == rest(first["y"])) & (told(first["x"]) != told(first["y"]))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(differ, F.lit(False)))
