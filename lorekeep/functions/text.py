"""Column functions over text: keywords, redaction, predicates, splitting, markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and suffixes that carry no topic.
STOPWORDS = "a an and are as at be by do does for from how in is it of on or our should the this to was what when where which who why with".split()
PARTICLES = "에서 부터 까지 으로 처럼 이나 은 는 이 가 에 의 로 을 를 와 과 도 만".split()
FILLERS = (
    "그러면 그럼 근데 그런데 그리고 그래서 그러니까 그니까 그래도 그래 그냥 지금 이제 아까 일단 다시 계속 이미 원래 혹시 진짜 정말 "
    "이거 저거 그거 이건 저건 그건 이게 저게 그게 이걸 저걸 그걸 이런 저런 그런 이렇게 저렇게 그렇게 어떻게 어떤 무슨 뭔가 아니 아니면 우리 저기 "
    "so now then ok okay we you me my did can could would will that there here just again about if but not no yes please"
).split()

#: Bytes of a token that the index holds.
TOKEN_BYTES = 40
SEPARATORS = r"""[\s\p{IsWhite_Space},;:!?'"()\[\]{}]+"""
PARTICLE = "^(.+?)(?:" + "|".join(PARTICLES) + ")$"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

#: Java's word boundary knows letters of every script; these patterns need the ASCII one, so that a key next to Hangul is found.
EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
# Shapes of credentials; @ stands for the ASCII word boundary.
SECRETS = [
    r"@(sk-[A-Za-z0-9][A-Za-z0-9_-]{16,})@",
    r"@(xox[abeprs]-[A-Za-z0-9-]{10,}|xapp-[0-9]-[A-Za-z0-9-]{10,})@",
    r"@(gh[pousr]_[A-Za-z0-9_]{20,})@",
    r"@(github_pat_[A-Za-z0-9_]{20,})@",
    r"@((?:AKIA|ASIA)[0-9A-Z]{16})@",
    r"@eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"@((?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,})@",
    r"@(glpat-[A-Za-z0-9_-]{20,})",
    r"@(npm_[A-Za-z0-9]{36})@",
    r"@(hf_[A-Za-z0-9]{30,})@",
    r"-----BEGIN (RSA |OPENSSH |EC |DSA |)PRIVATE KEY-----[\s\S]*?-----END (RSA |OPENSSH |EC |DSA |)PRIVATE KEY-----",
    r"@(AIza[0-9A-Za-z_-]{35})@",
]
#: Literals of which every match of a shape holds one, and, lower-cased, every match of a key's value or a bearer token.
SHAPE_HINTS = ("sk-", "xox", "xapp-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "AKIA", "ASIA", "eyJ", "_live_", "_test_", "glpat-", "npm_", "hf_", "PRIVATE KEY-----", "AIza")
KEY_HINTS = ("api", "access", "token", "secret", "password", "passwd", "pwd", "authorization", "bearer")
KEY_VALUE = r"""(?i)\b((?:[A-Za-z0-9]+[_-])*(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|authorization|bearer)(?:[_-][A-Za-z0-9]+)*)\b['"]?\s*[:=]\s*['"]?([^'"\s,;]{8,})"""
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}"
URL_PASSWORD = r"(?i)(\b[a-z][a-z0-9+.-]*://[^/\s:@]+:)[^@\s/]{3,}@"
REMINDER = r"(?s)<system-reminder>.*?(?:</system-reminder>|\z)"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_particle(token: Column) -> Column:
    """Drop one Korean particle from the end, the first of the list that fits; never the whole token."""
    return F.when(token.isin(*PARTICLES), token).otherwise(F.regexp_replace(token, PARTICLE, "$1"))


def keywords(text: str | Column, least: int = 2) -> Column:
    """Words that may match a memory, in order, case and repeats kept."""
    return _topical(text, F.split(_col(text), SEPARATORS), least)


def _topical(text: str | Column, words: Column, least: int = 2) -> Column:
    long = lambda t: F.char_length(t) >= least
    tokens = F.filter(words, long)
    # particles are Hangul: without any, no word has one to lose
    bare = F.when(is_korean(text), F.transform(tokens, strip_particle)).otherwise(tokens)
    return F.filter(bare, lambda t: long(t) & ~F.lower(t).isin(*STOPWORDS))


def topic_keywords(text: str | Column) -> Column:
    """Words that show a topic: lower-cased, each once, without fillers."""
    # each word once before the patterns too: a document has many words again and again
    once = _topical(text, F.array_distinct(F.split(_col(text), SEPARATORS)))
    bare = F.transform(once, lambda t: F.lower(F.regexp_replace(t, EDGES, "")))
    return F.array_distinct(F.filter(bare, lambda t: (F.char_length(t) >= 2) & ~t.isin(*FILLERS)))


def all_tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits, each in its place."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def fits(token: str | Column) -> Column:
    """Whether the index holds a token: longer ones keep their place, but can't be found."""
    return F.octet_length(_col(token)) <= TOKEN_BYTES


def tokens(text: str | Column) -> Column:
    """The index's tokens: lower-cased runs of letters and digits of at most 40 bytes."""
    return F.filter(all_tokens(text), fits)


def is_korean(text: str | Column) -> Column:
    return _col(text).rlike("[가-힣]")


def is_ascii(text: str | Column) -> Column:
    return _col(text).rlike(r"^[\x00-\x7F]*$")


def has_latin_term(text: str | Column, term: str | Column) -> Column:
    """The term stands as a whole word; neighbours that aren't ASCII letters or digits (a particle, say) don't join it."""
    folded, clean = _fold(_col(text)), _fold(_col(term))
    spaced = F.concat(F.lit(" "), F.regexp_replace(folded, "[^0-9a-z]", " "), F.lit(" "))
    quoted = F.concat(F.lit(r"(?<![0-9a-z])\Q"), clean, F.lit(r"\E(?![0-9a-z])"))
    # a term of letters and digits needs no pattern of its own
    return F.when(clean.rlike("^[0-9a-z]+$"), F.contains(spaced, F.concat(F.lit(" "), clean, F.lit(" ")))).otherwise(F.regexp_like(folded, quoted))


def _fold(text: Column) -> Column:
    """ASCII letters to lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def redact(text: str | Column) -> Column:
    """Credentials masked: known shapes, then values of telling keys, bearer tokens, passwords in URLs.

    Texts without a literal that any match holds aren't searched for patterns.
    """
    text = _col(text)
    shaped = reduce(lambda c, p: F.regexp_replace(c, p.replace("@", EDGE), "[REDACTED_SECRET]"), SECRETS, text)
    out = F.when(_any_of(text, SHAPE_HINTS), shaped).otherwise(text)
    keyed = F.regexp_replace(out, KEY_VALUE, "$1: [REDACTED]")
    keyed = F.regexp_replace(keyed, BEARER, "Bearer [REDACTED]")
    keyed = F.regexp_replace(keyed, URL_PASSWORD, "$1[REDACTED]@")
    return F.when(_any_of(F.lower(text), KEY_HINTS) | (F.contains(text, F.lit("://")) & F.contains(text, F.lit("@"))), keyed).otherwise(out)


def _any_of(text: Column, literals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in literals))


def looks_like_secret(text: str | Column) -> Column:
    found = reduce(lambda a, b: a | b, (_col(text).rlike(p.replace("@", EDGE)) for p in SECRETS))
    return _any_of(_col(text), SHAPE_HINTS) & found


def parts(text: str | Column, size: int = 8000) -> Column:
    """Parts of ``size`` code points, in order; an empty text is one empty part."""
    text = _col(text)
    last = F.greatest(F.ceil(F.char_length(text) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def spoken(role: Column, text: Column) -> Column:
    """A turn's document: who speaks, then what."""
    return F.concat(F.when(role == "user", "User said: ").otherwise("Assistant answered: "), text)


def strip_reminders(text: str | Column) -> Column:
    """Without reminder blocks; one that isn't closed takes the rest."""
    return F.regexp_replace(_col(text), REMINDER, "")


def escape_markup(text: str | Column) -> Column:
    return F.replace(F.replace(F.replace(_col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def one_line(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"[\s\p{IsWhite_Space}]+", " "))


def clip(text: str | Column, most: int) -> Column:
    """The first so many code points."""
    return F.left(_col(text), F.lit(most))


def defuse(text: str | Column) -> Column:
    """Reminder tags lose their bracket, so that stored text can't open or close one."""
    return F.regexp_replace(_col(text), r"(?i)<(/?\s*system[-_ ]?reminder)", "‹$1")


def card_title(text: str | Column) -> Column:
    """A card's title: one line of at most 120 code points that can't pose as markup."""
    return F.rtrim(clip(F.translate(one_line(text), "<>", "‹›"), 120))


def normalised_query(text: str | Column) -> Column:
    """For noticing a repeated question: one line, lower case, 240 code points."""
    return F.left(F.lower(one_line(text)), F.lit(240))


def worth_searching(prompt: str | Column, least: int = 12) -> Column:
    """Not too short for a question, and no command."""
    clean = F.trim(_col(prompt))
    return (F.char_length(clean) >= least) & ~clean.startswith("/")


def substantive(prompt: str | Column, least: int = 16, trivial: tuple[str, ...] = ()) -> Column:
    """A client's stricter test; ``trivial`` names words that only keep a conversation going, for bounds that they'd pass."""
    return worth_searching(prompt, least) & ~F.lower(F.trim(_col(prompt))).isin(*trivial)


def is_digest(text: str | Column) -> Column:
    """A SHA-256 digest in lower-case hexadecimal digits."""
    return _col(text).rlike("^[0-9a-f]{64}$")


def is_transcript_id(text: str | Column) -> Column:
    return _col(text).rlike("^transcript_[0-9a-fA-F]{32}$")


def is_safe_path(text: str | Column, most: int = 256) -> Column:
    """A relative path within a work tree that any system can hold and that holds no secret.

    No control sign, backslash or colon; no empty or dot part, none of version control's own, none that ends in a dot or space.
    """
    t = _col(text)
    bad = lambda p: p.isin("", ".", "..") | (F.lower(p) == ".git") | p.endswith(".") | p.endswith(" ")
    return (F.octet_length(t) <= most) & ~t.rlike(r"[\p{Cntrl}\x{80}-\x{9F}\\:]") & ~F.exists(F.split(t, "/"), bad) & (redact(t) == t)


def hint_can_name(project: str | Column) -> Column:
    """A project name that may be shown: 1 to 80 letters and digits of any script, or -_./"""
    return _col(project).rlike(r"^[\p{L}\p{N}\-_./]{1,80}$")


def evidence_ids(text: str | Column) -> Column:
    """Normalised dialogue references, D<session>:<turn>, without leading zeros."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(D?:?\d+:\d+)"), 1)
    number = lambda e, g: F.regexp_extract(e, r"D?:?(\d+):(\d+)", g).cast("long").cast("string")
    return F.transform(found, lambda e: F.concat(F.lit("D"), number(e, 1), F.lit(":"), number(e, 2)))


def answers_all(text: str | Column, groups: str | Column) -> Column:
    """Every group has an alternative that the answer holds, whatever its case."""
    low = F.lower(_col(text))
    return F.forall(_col(groups), lambda g: F.exists(g, lambda t: F.contains(low, F.lower(t))))
