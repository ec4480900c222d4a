"""Secret scan: a wide pattern for candidates, a random forest against false ones.

DataFrame expressions only. A candidate is a private key from its header to its
footer (without one, the header and the key lines after it), any value that is
assigned to a secret-like name (in quotes: all between them), or a run of 16 or
more token characters; a name before ``=`` is no part of the value. Features of
a candidate and the text around it (length, character transitions, dictionary
coverage, path, neighbouring words) go to a forest trained here from labelled
findings, which the scanner's own split of labelled texts gives; a
finding is a secret if at least ``threshold`` of the trees say so. The forest
is turned into one expression over the array of a row's candidates, so nothing
is exploded or shuffled and a row may hold any number of candidates; their
places are running sums made by doubling, so the work is n log n in them.

Training takes at most ``max_findings`` labelled findings (in the order of
their hash, in one partition, with a fixed seed, so the same findings give the
same forest anywhere).

Null texts have no candidates and stay null; so do empty ones, unchanged. Rows
are mapped one to one; columns that clash with the output names are replaced.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.quality import let
from graphloom.llm.rows import ROW, boxed, others, own, quoted

# What a candidate looks like. One pattern for Java's and Python's
# expressions: what stands before a value is checked by looks behind of one width each.
CHARS = r"[A-Za-z0-9+/_\-]"
SECRET_NAMES = "token secret passwd password passphrase pwd auth apikey api_key api-key accesskey access_key access-key bearer credential credentials privatekey private_key private-key signing signing_key clientkey client_key client-key webhook".split()


def _candidate() -> str:
    kind = r"[A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    # Up to the footer (dashes of header fields apart), or whole lines of key characters.
    pem = rf"-----BEGIN {kind}(?:[^\-]*+(?:-{{1,4}}[^\-]++){{0,32}}+-----END {kind}|[A-Za-z0-9+/=\\\r\n]*(?![^\r\n])|)"
    blank, quote = r" \t\r\n\f\x0b", "\"'`"
    # An assignment ends here, and a secret-like name stands at most 20 characters before.
    ends = "|".join(f"(?<=[=:>]{w})" for w in ("", r"[ \t]", r"[ \t]{2}", f"[{quote}]", f"[ \\t][{quote}]", f"[ \\t]{{2}}[{quote}]"))
    by_size = {n: "|".join(x for x in SECRET_NAMES if len(x) == n) for n in sorted({len(x) for x in SECRET_NAMES})}
    named = "|".join(rf"(?<=(?i:{names})[A-Za-z0-9_.\-{quote}\])=:> \t]{{{gap}}})" for names in by_size.values() for gap in range(1, 21))
    quoted = "|".join(rf"(?<={q})(?=[ \t]*[^{blank}{q}])[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+){{0,64}}+(?={q})" for q in quote)
    # A bare value ends at a blank, a quote, a tag or the next parameter; closing punctuation is no part of it.
    more = r"&(?![A-Za-z_][A-Za-z0-9_.\-]{0,40}=)"
    bare = rf"(?:[^{blank}{quote},;&=:>]|{more})[^{blank}{quote}&<]*(?:{more}[^{blank}{quote}&<]*){{0,32}}(?<![.,;:!?)\]}}>&])"
    value = rf"(?<=[=:> \t{quote}])(?:{ends})(?:{named})(?!(?i:bearer|basic)[ \t])(?:{quoted}|{bare})"
    bearer = rf"(?<=(?i:bearer) )(?={CHARS}*[0-9]){CHARS}{{6,}}+"
    run = rf"(?<!{CHARS})(?=[+/_\-]*[A-Za-z0-9]){CHARS}{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_\-={quote}]))?"
    return f"{pem}|{value}|{bearer}|{run}"


CANDIDATE = _candidate()
#: Characters of the text beside a candidate that its features see, from the candidate before to the one after.
BESIDE = 48
MASK = "[SECRET]"
# Prefixes of issued keys.
ISSUED = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ|sk-|sk_live_|rk_live_|SG\.|-----BEGIN)"
# Words of names, paths and placeholders that random strings seldom hold.
DICTIONARY = (
    "access account address admin alpha application archive array article asset auth back base beta block book build button cache card case chapter class click client code color column comment common component config "
    "content control count create custom data date default delete demo detail device directory document domain download dummy edit element email event example export feature field file filter first folder font form format "
    "frame function group handler header heading height home host html image import index info input item json label layer layout left letter level library light line link linux list local login long main manager map menu message "
    "method mobile model module month name network node note number object option order output package page panel parent part path people phone photo place player point position post preview price process product profile project "
    "public query random record reference release remote report request response result right root row sample scale school script search section select server service session setting share shop short simple site size sort source space "
    "stack start state static status step store stream string style system table target task team template test text theme thread time title token tool total track type update upload user value version video view wallet web week widget width window word world"
)
BEFORE_SECRET = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|signing|client.?key|webhook)[^\n]{0,16}$"
BEFORE_OTHER = r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|integrity|uuid|guid|isbn|issn|order|invoice|phone|tel|fax|card|iban|account|tracking|serial|version|build|etag|blob|tree|href|src|url)[^\n]{0,12}$"
PLACEHOLDER = r"(?i)x{4,}|0{6,}|\*{3,}|1234|abcd|example|sample|dummy|change_?me|your|test|placeholder|redacted|[<>{}$()\[\]]|^(?:null|none|nil|true|false|undefined|required|optional|string)$"
FEATURES = ("length", "digits", "upper", "class_turns", "letter_digit_turns", "vowel_turns", "distinct", "dictionary", "hex", "only_digits", "issued", "secret_word", "other_word", "assigned", "quoted", "path", "placeholder", "dashes", "symbols")


def features(before: Column, candidate: Column, after: Column) -> list[Column]:
    """The numbers of FEATURES, each a double, of a candidate and the text beside it."""
    c, size = candidate, F.length(candidate)
    share = lambda pattern, of=c: (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))) / size
    turns = lambda pattern: (F.length(F.regexp_replace(c, pattern, "~")) - size) / size
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    words = "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    out = [
        F.least(size, F.lit(200)),
        share("[0-9]"),
        share("[A-Z]"),
        turns(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        turns(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        turns(r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64)),
        share(words, F.lower(c)),
        flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(c.rlike("^[0-9]+$")),
        flag(c.rlike(ISSUED)),
        flag(before.rlike(BEFORE_SECRET)),
        flag(before.rlike(BEFORE_OTHER)),
        flag(before.rlike(r"[=:][ \t]{0,2}[\"'`]?$")),
        flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        flag(c.contains("/") | before.rlike(r"[/\\.]$") | after.rlike(r"^\.[a-z]{2,4}\b|^[/\\]")),
        share(PLACEHOLDER),
        share("[-_]"),
        share("[^A-Za-z0-9+/_=-]"),
    ]
    return [x.cast("double") for x in out]


def split_text(text: str) -> list[tuple[int, str, str, str]]:
    """(start, before, candidate, after) of a text, as ``scan_secrets`` splits it, on the driver."""
    found = [(m.start(), m.end()) for m in re.finditer(CANDIDATE, text)]
    edges = [0, *(a for a, _ in found)], [*(a for a, _ in found[1:]), len(text)]
    return [(a, text[max(a - BESIDE, start) : a], text[a:b], text[b : min(b + BESIDE, end)]) for (a, b), start, end in zip(found, *edges, strict=False)]


def sample_texts(n: int = 3000, seed: int = 11) -> list[tuple[str, int, str]]:
    """Labelled texts (text, start, secret) made from templates; start is -1 without a secret.

    Keys, passwords and key blocks as they are issued and assigned in code and
    prose, against commit ids, checksums, uuids, numbers, paths, identifiers,
    placeholders and words that follow a secret-like name.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, hexa, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    letters, mixed = low + low.upper(), low + low.upper() + digits
    syllables = "an er in on th re he ti en st ou ha ar de la es qu io un ge ein sch ver men".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    names = DICTIONARY.split()
    ident = lambda sep: sep.join(r.choice(names) for _ in range(r.randint(2, 4)))
    secret_names = ["token", "secret", "password", "api_key", "apiKey", "auth_token", "access_key", "client_secret", "TOKEN", "SECRET_KEY", "passwd", "credential", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "https://host/x?token", "https://host.org/a?id=3&api_key"]
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    lines = lambda: "\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(2, 25)))
    issued = [
        lambda: "AKIA" + pick(low.upper() + "234567", 16),
        lambda: "ghp_" + pick(mixed, 36),
        lambda: "AIza" + pick(mixed + "_-", 34) + r.choice(digits),
        lambda: "sk_live_" + pick(mixed, 24),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24),
        lambda: "eyJ" + pick(mixed, 34),
    ]
    positive = [
        *issued,
        lambda: pick(hexa, r.choice([32, 40, 48, 64])),
        lambda: pick(mixed, r.randint(20, 65)),
        lambda: pick(letters, r.randint(16, 40)),
        lambda: pick(mixed + "+/", 44) + "=",
        lambda: pick(letters, r.randint(8, 20)) + r.choice(["abcd", "1234", "test", "0000000"]) + pick(letters, r.randint(8, 20)),
        lambda: low[r.randint(0, 8) :] + low.upper()[: r.randint(3, 12)],
    ]
    password = [
        lambda: pick(mixed + "&!#%@^*", r.randint(7, 15)) + r.choice(digits),
        lambda: word().capitalize() + r.choice(digits) + word() + r.choice("&!#%@") + r.choice(digits),
        lambda: word() + pick(digits, r.randint(1, 3)),
    ]
    phrase = lambda: r.choice("- _.").join(r.choice([word(), r.choice(names)]) for _ in range(r.randint(3, 6)))
    pem = lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----\n" + r.choice(["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n"]) + lines() + f"\n-----END {kind}PRIVATE KEY-----"
    said = ["required", "optional", "null", "None", "true", "string", "missing", "invalid", "the", "see", "expired", "hidden", "not", "it", "you", "this", "never", "${TOKEN}", "$PASSWORD", "<password>", "os.environ", "********", "{{secret}}", "getenv(KEY)"]
    negative = [
        (lambda: r.choice(["commit ", "sha256: ", "md5 ", "checksum: ", "revision ", "integrity ", "digest = \"", "etag: "]), lambda: pick(hexa, r.choice([32, 40, 64]))),
        (lambda: r.choice(["id ", "uuid: ", "guid=", "", "request "]), uuid),
        (lambda: r.choice(["order ", "card ", "phone ", "serial ", "account ", "", "isbn ", "tracking "]), lambda: pick(digits, r.randint(16, 24))),
        (lambda: r.choice(["", "see ", "in ", "/", "src=\"/", "href=\"", "//"]), lambda: ident("/") + "/" + ident("_") + r.choice(["", str(r.randint(0, 99))])),
        (lambda: r.choice(["", "call ", "the ", "def ", "class ", "id=\""]), lambda: ident("_") + r.choice(["", "_" + str(r.randint(0, 2030))])),
        (lambda: r.choice(["", "on ", "file "]), lambda: ident("-") + r.choice(["", "-" + pick(digits, 4)])),
        (lambda: r.choice(["token = \"", "password: ", "api_key='", "secret="]), lambda: r.choice(["your_token_here_", "example-secret-", "xxxxxxxxxxxxxxx", "placeholder_", "changeme_test_", "000000000000000", "changeme"]) + r.choice(["", str(r.randint(10, 9999))])),
        (lambda: r.choice(["", "is ", "and "]), lambda: "".join(word() for _ in range(5)) + r.choice(["", str(r.randint(1, 999)) + word()])),
        (lambda: r.choice(["", ". ", "is "]), lambda: r.choice([str.capitalize, str.upper, str.lower])(("".join(word() for _ in range(6)) + "schaftlichkeit")[: r.randint(16, 24)])),
        (lambda: "", lambda: "=" * r.randint(8, 20) + str(r.randint(1, 999)) + "-" * r.randint(8, 20)),
        (lambda: r.choice(secret_names[:12]) + r.choice([": ", " = ", "="]), lambda: r.choice([r.choice(said), word()])),
        (lambda: r.choice(["password", "token", "secret"]) + r.choice([": \"", " = \""]), lambda: r.choice(said)),
    ]
    out = []
    for k in range(n):
        start, end = prose() + " ", " " + prose()
        kind = r.random()
        if k % 2 == 0:
            lead, make = r.choice(negative)
            at = lead()
            out.append((start + at + make() + ("\"" if at.endswith("\"") else "'" if at.endswith("'") else "") + end, -1, ""))
            continue
        if kind < 0.08:
            lead, secret, close = r.choice(["", "key = \"", "key:\n"]), pem(r.choice(["", "RSA ", "EC ", "OPENSSH "])), ""
        elif kind < 0.22:
            lead, secret, close = r.choice(["", "key ", "value: ", "Authorization: Bearer "]), r.choice(issued)(), ""
        elif kind < 0.45:
            quote = r.choice(["\"", "'"])
            lead, secret, close = r.choice(secret_names[:14]) + r.choice([" = ", "=", ": ", ":"]) + quote, r.choice([*password, phrase])(), quote
        elif kind < 0.55:
            lead, secret, close = r.choice(secret_names[:14]) + r.choice([" = ", "=", ": "]), r.choice(password)(), ""
        else:
            quote = r.choice(["\"", "'", "", "\""])
            lead, secret, close = r.choice(secret_names) + r.choice([" = ", "=", ": ", ":"] if quote else ["=", "=", ": "]) + quote, r.choice(positive)(), quote
        out.append((start + lead + secret + close + end, len(start + lead), secret))
    return out


def sample_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, label): all candidates of ``sample_texts``.

    A candidate that is not the whole secret is none, and a secret that is no
    candidate is an error.
    """
    rows = []
    for text, start, secret in sample_texts(n, seed):
        found = split_text(text)
        if start >= 0 and not any((at, c) == (start, secret) for at, _, c, _ in found):
            raise ValueError(f"not a candidate: {secret!r} in {text!r}")
        rows += [(before, c, after, int((at, c) == (start, secret))) for at, before, c, after in found]
    return rows


class Forest:
    """Trees as nested tuples: (feature, threshold, left, right), or a leaf's class."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def parse(cls, debug: str) -> Forest:
        """From the text form of a fitted forest of the ML library."""
        trees, lines = [], [x.strip() for x in debug.splitlines()[1:]]

        def node(at: int):
            if m := re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", lines[at]):
                left, at = node(at + 1)
                right, at = node(at + 1)
                return (int(m[1]), float(m[2]), left, right), at
            return float(re.match(r"Predict: ([-+.\dEe]+)", lines[at])[1]), at + 1

        at = 0
        while at < len(lines):
            if lines[at].startswith("Tree"):
                tree, at = node(at + 1)
                trees.append(tree)
            else:
                at += 1
        return cls(trees)

    def score(self, row: list[float]) -> float:
        """Share of trees that say secret, of one row on the driver (for tests)."""

        def walk(t):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return sum(map(walk, self.trees)) / len(self.trees)

    def column(self, values: Column) -> Column:
        """The same as an expression over an array of features."""

        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(t)
            return F.when(F.get(values, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / len(self.trees)


_forests: dict[tuple, Forest] = {}


def train(spark: SparkSession, findings: DataFrame | None = None, max_findings: int = 20_000, trees: int = 15, depth: int = 6, seed: int = 7) -> Forest:
    """A forest from labelled findings (before, candidate, after: strings; label: 0 or 1)."""
    key = (spark.sparkContext.applicationId, max_findings, trees, depth, seed)
    if findings is None and key in _forests:
        return _forests[key]
    given = findings if findings is not None else spark.createDataFrame(sample_findings(), "before string, candidate string, after string, label int")
    bounded = given.orderBy(F.xxhash64("before", "candidate", "after"), "before", "candidate", "after", "label").limit(max_findings).coalesce(1)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = bounded.select(F.col("label").cast("double").alias("label"), *(x.alias(n) for x, n in zip(features(text("before"), text("candidate"), text("after")), FEATURES, strict=True)))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)
    forest = Forest.parse(model.toDebugString)
    if findings is None:
        _forests[key] = forest
    return forest


def running_sums(numbers: Column) -> Column:
    """Sums of an array's first 1, 2, ... elements: each pass adds what stands 2^k places before."""

    def wider(sums: Column, step: int) -> Column:
        added = lambda s: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - step), F.lit(0)))
        return let(sums, lambda s: F.when(F.size(s) > step, added(s)).otherwise(s))

    for k in range(31):
        numbers = wider(numbers, 1 << k)
    return numbers


def scan_secrets(df: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with candidates: an array of (start, candidate, score, secret) in text order.

    start counts characters from 0.
    """
    text = F.col(quoted(text_col))

    def judged(parts: Column, found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda c, i: F.length(c) + F.length(F.get(parts, i))))
        return let(ends, lambda e: F.transform(found, lambda c, i: one(parts, found, e, c, i)))

    def one(parts: Column, found: Column, ends: Column, c: Column, i: Column) -> Column:
        start = F.get(ends, i) - F.length(c)
        # A long name is a candidate of its own, and stands before the value all the same.
        last = F.coalesce(F.get(found, i - 1), F.lit(""))
        before, after = F.right(F.concat(last, F.get(parts, i)), F.lit(BESIDE)), F.left(F.get(parts, i + 1), F.lit(BESIDE))
        score = let(F.array(*features(before, c, after)), forest.column)
        return let(score, lambda s: F.struct(start.alias("start"), c.alias("candidate"), s.alias("score"), (s >= threshold).alias("secret")))

    some = let(F.split(text, CANDIDATE, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: judged(parts, found)))
    none = F.array().cast("array<struct<start:int,candidate:string,score:double,secret:boolean>>")
    return df.select(*(F.col(quoted(c)) for c in others(df, "candidates")), F.when(text.rlike(CANDIDATE), some).otherwise(none).alias("candidates"))


def redacted(text: Column, candidates: Column, mask: str = MASK) -> Column:
    """The text with each secret of ``candidates`` replaced; null for null."""
    shown = F.transform(candidates, lambda c: F.when(c["secret"], F.lit(mask)).otherwise(c["candidate"]))
    joined = lambda p, s: F.array_join(F.zip_with(p, s, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    whole = let(shown, lambda s: let(F.split(text, CANDIDATE, -1), lambda p: joined(p, s)))
    return F.when(F.exists(candidates, lambda c: c["secret"]), whole).otherwise(text)


def redact_secrets(df: DataFrame, forest: Forest, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with secrets masked in the text and, where there is such a column, its length."""
    found = scan_secrets(boxed(df, F.col(quoted(text_col)).alias("text")), forest).withColumn("text", redacted(F.col("text"), F.col("candidates")))
    new = {text_col: F.col("text")}
    if length_col in df.columns:
        changed = F.exists("candidates", lambda c: c["secret"])
        new[length_col] = F.when(changed, F.length("text")).otherwise(F.col(f"{ROW}.{quoted(length_col)}")).cast(df.schema[length_col].dataType)
    return found.select(*(new.get(c, F.col(f"{ROW}.{quoted(c)}")).alias(c) for c in df.columns))


def secret_report(df: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """n_candidates, n_secrets, secret_starts and redacted_sha256 in place of the text."""
    new = (text_col, "n_candidates", "n_secrets", "secret_starts", "redacted_sha256")
    secret = F.filter("candidates", lambda c: c["secret"])
    return scan_secrets(boxed(df, F.col(quoted(text_col)).alias("text"), but=new), forest).select(
        *own(df, *new),
        F.size("candidates").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.array_join(F.transform(secret, lambda c: c["start"].cast("string")), ",").alias("secret_starts"),
        F.sha2(redacted(F.coalesce(F.col("text"), F.lit("")), F.col("candidates")), 256).alias("redacted_sha256"),
    )
