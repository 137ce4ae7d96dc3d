"""Personal data by weak supervision, with DataFrame and SQL functions only.

Strict patterns give the base spans, which always stay. Looser candidates (account numbers, local phone numbers, spelled
out mail addresses, credentials) are voted on by five labelers: the pattern's own shape, a structural check, a
gazetteer, words of context before the span, and the way it is written. Votes are yes, no or none. Counts of vote
patterns, a table of bounded size, are all that comes to the driver: expectation-maximisation estimates there how
reliable each labeler is for each kind, and a logistic span classifier is trained on the posteriors. It goes back into
the query as an expression, and the candidates that it accepts are added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written

# The strict patterns. A run is entered at its start or where the last match ended, which finds the same
# leftmost matches without trying every position of a long run, and repeats are possessive where nothing is given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Loose candidates; account numbers are what the card pattern matches and the card rule drops.
LOOSE = {
    "local_phone": r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "contact": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[a-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[a-z0-9-]++)++",
    "credential": r"(?i)\b(?:api[_-]?key|access[_-]?key|auth|key|passwd|password|secret|token)\x20?[=:]\x20?[\"']?[a-z0-9_+/=-]{16,}+",
}
KINDS = [*BASE, "account", *LOOSE]
ADDED = ["account", *LOOSE]
LABELERS = ["shape", "check", "gazetteer", "context", "writing"]
YES_WORDS = {
    "account": r"account|acct|card|iban|konto|cuenta|compte|visa|credit|pay",
    "local_phone": r"call|phone|tel|mobile|fax|contact|whatsapp|anruf|llame|appel",
    "contact": r"mail|contact|write|reach|correo|courriel",
    "credential": r"api|secret|login|auth|deploy|export|config",
}
NO_WORDS = r"order|invoice|isbn|issn|page|version|item|sku|part no|ref|row|line|build"
# Gazetteers. Issuers are ranges of an account's first four digits.
ISSUERS = [(2221, 2720), (3400, 3499), (3528, 3589), (3700, 3799), (4000, 4999), (5100, 5599), (6011, 6011), (6200, 6299), (6440, 6599)]
ENDINGS = ["com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "ai", "app", "dev", "eu", "uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pt", "pl", "cz", "dk", "se", "no", "fi", "ie", "gr", "hu", "ro", "ru", "ua", "tr", "il", "in", "cn", "jp", "kr", "hk", "tw", "sg", "th", "vn", "id", "my", "ph", "au", "nz", "za", "ng", "ke", "eg", "br", "mx", "ar", "cl", "co", "pe", "ca", "us"]
SECRET_WORDS = ["apikey", "accesskey", "token", "secret", "password", "passwd", "auth"]
#: Matches that are put together at once; folds over more would copy all that they have.
CHUNK = 256


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    doubled = "(2 * d - if(d > 4, 9, 0))"
    each = f"aggregate(sequence(1, length({x})), 0, (n, i) -> n + element_at(transform(array(cast(substr({x}, i, 1) as int)), d -> if((length({x}) - i) % 2 = 1, {doubled}, d)), 1))"
    return f"({each} % 10 = 0)"


RULES = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(if(ltrim('0', p) = '', '0', substr(ltrim('0', p), 1, 3)) as int) <= 255)",
    "card": f"length({digits('x.m')}) between 16 and 19 and {luhn(digits('x.m'))}",
    "phone": f"length({digits('x.m')}) between 8 and 15",
}
SPAN = "array<struct<s:int,e:int,m:string,c:string>>"


def located(matches: str, pieces: str) -> str:
    """SQL: (start, end, match, what stands before it) of each match, in code points, from a text's matches and the pieces between them.

    The fold goes by chunks, as each step copies what it has put together.
    """
    one = f"""(acc, x) -> struct(acc.at + length(x.p) + length(x.m) as at, array_append(acc.spans,
        struct(acc.at + length(x.p) as s, acc.at + length(x.p) + length(x.m) as e, x.m as m, lower(right(x.p, 40)) as c)) as spans)"""
    chunk = f"zip_with(slice({pieces}, i * {CHUNK} + 1, least({CHUNK}, size({matches}) - i * {CHUNK})), slice({matches}, i * {CHUNK} + 1, {CHUNK}), (p, m) -> struct(p, m))"
    inner = f"aggregate({chunk}, struct(got.at as at, cast(array() as {SPAN}) as spans), {one})"
    return f"""case when size({matches}) > 0 then aggregate(
        sequence(0, cast(floor((size({matches}) - 1) / {CHUNK}) as int)),
        struct(0 as at, cast(array() as array<{SPAN}>) as chunks),
        (got, i) -> transform(array({inner}), r -> struct(r.at as at, array_append(got.chunks, r.spans) as chunks))[0],
        got -> flatten(got.chunks)) else cast(array() as {SPAN}) end"""


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, one array of spans for each strict kind and each kind of candidates)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    patterns = BASE | LOOSE
    out = out.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()))
    pieces = (F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in patterns.items())
    out = out.select("doc_id", *(f"m_{k}" for k in patterns), *pieces)
    out = out.select("doc_id", *(F.expr(located(f"m_{k}", f"p_{k}")).alias(k) for k in patterns))
    kept = {k: f"filter({k}, x -> {RULES[k]})" for k in BASE}
    account = f"filter(card, x -> length({digits('x.m')}) between 13 and 19 and not ({RULES['card']}))"
    out = out.select("doc_id", *(F.expr(v).alias(k) for k, v in kept.items()), F.expr(account).alias("account"), *LOOSE)
    # a candidate that meets a base span is no news
    base = "concat(email, ip, card, phone)"
    apart = {k: F.expr(f"filter({k}, x -> not exists({base}, b -> b.s < x.e and x.s < b.e))").alias(k) for k in ADDED}
    return out.select("doc_id", *BASE, *apart.values())


def votes(kind: str) -> list[str]:
    """SQL of the five labelers' votes on a candidate x: 1, 0, or -1 for none."""
    d = digits("x.m")
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    context = f"case when x.c rlike '{YES_WORDS[kind]}' then 1 when x.c rlike '{NO_WORDS}' then 0 else -1 end"
    issued = " or ".join(f"cast(substr({d}, 1, 4) as int) between {low} and {high}" for low, high in ISSUERS)
    name = "regexp_replace(lower(regexp_extract(x.m, '^[^=:]*', 0)), '[^a-z]', '')"
    value = r"regexp_extract(x.m, '[=:][^a-zA-Z0-9_+/=-]*([a-zA-Z0-9_+/=-]+)$', 1)"
    return {
        "account": [
            f"if(length({d}) in (15, 16), 1, 0)",
            f"if({luhn(d)}, 1, 0)",
            f"if({issued}, 1, 0)",
            context,
            "if(x.m rlike '[ -]', 1, -1)",
        ],
        "local_phone": [
            "if(x.m rlike '^[(].*[)]' or regexp_replace(x.m, '[0-9]', '') in ('--', '..', '  '), 1, 0)",
            f"if(substr({d}, 4, 1) in ('0', '1'), 0, 1)",
            f"if(substr({d}, 1, 3) rlike '^[2-9](?!11)[0-8][0-9]$' and substr({d}, 1, 2) not in ('37', '96'), 1, 0)",
            context,
            "if(x.m like '(%', 1, -1)",
        ],
        "contact": [
            "if(lower(x.m) like '%(at)%' or lower(x.m) like '%[at]%', 1, 0)",
            "if(x.m rlike '[a-zA-Z]{2,}$', 1, 0)",
            f"if(regexp_extract(lower(x.m), '[a-z0-9-]+$', 0) in ({listed(ENDINGS)}), 1, 0)",
            context,
            "if(lower(x.m) like '%dot%', 1, -1)",
        ],
        "credential": [
            f"if(length({value}) >= 20, 1, 0)",
            f"if({value} rlike '[0-9]' and {value} rlike '[a-zA-Z]', 1, 0)",
            f"if({name} in ({listed(SECRET_WORDS)}), 1, 0)",
            context,
            "if(x.m rlike '[\"\\']', 1, -1)",
        ],
    }[kind]


def voted(found: DataFrame) -> DataFrame:
    """The candidates of each row as (kind, start, end, votes)."""
    each = (
        f"transform({k}, x -> struct({i} as k, x.s as s, x.e as e, array({', '.join(f'cast({v} as int)' for v in votes(k))}) as v))"
        for i, k in enumerate(ADDED)
    )
    return found.select("doc_id", *BASE, F.expr(f"concat({', '.join(each)})").alias("candidates"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> list[float]:
    """Expectation-maximisation with two reliabilities for each kind and labeler; the posterior of each pattern."""
    post = [0.5 + 0.4 * math.tanh(sum({1: 1, 0: -1}.get(x, 0) for x in v)) for _, v, _ in counts]
    for _ in range(rounds):
        new = [0.0] * len(post)
        for kind in {k for k, _, _ in counts}:
            own = [i for i, (k, _, _) in enumerate(counts) if k == kind]
            total = sum(counts[i][2] for i in own)
            share = (sum(post[i] * counts[i][2] for i in own) + 1) / (total + 2)
            odds = {}
            for j in range(len(LABELERS)):
                for value in (0, 1):
                    for truth in (0, 1):
                        weight = lambda i: (post[i] if truth else 1 - post[i]) * counts[i][2]  # noqa: E731, B023
                        said = sum(weight(i) for i in own if counts[i][1][j] == value)
                        spoke = sum(weight(i) for i in own if counts[i][1][j] >= 0)
                        prior = 4.0 if value == truth else 1.0  # labelers are better than chance to begin with
                        odds[j, value, truth] = (said + prior) / (spoke + 5.0)
            for i in own:
                yes, no = math.log(share), math.log(1 - share)
                for j, value in enumerate(counts[i][1]):
                    if value >= 0:
                        yes, no = yes + math.log(odds[j, value, 1]), no + math.log(odds[j, value, 0])
                new[i] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
        post = new
    return post


def classifier(counts: list[tuple[int, tuple[int, ...], int]]) -> np.ndarray:
    """Weights (one of each kind, then one of each labeler's yes against no) of a logistic curve through the posteriors."""
    size = len(ADDED) + len(LABELERS)
    if not counts:
        return np.zeros(size)
    x = np.zeros((len(counts), size))
    for i, (k, v, _) in enumerate(counts):
        x[i, k] = 1
        x[i, len(ADDED) :] = [{1: 1, 0: -1}.get(y, 0) for y in v]
    y, n = np.array(reliabilities(counts)), np.array([c for _, _, c in counts], float)
    w = np.zeros(size)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(size), x.T @ (n * (y - p)) - w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w.round(9)


def joined(parts: list[tuple[str, str]]) -> str:
    """SQL: kind:start:end of (kind, array of spans) in turn, joined by commas."""
    each = (f"transform({a}, x -> concat('{k}:', x.s, ':', x.e))" for k, a in parts)
    return f"array_join(concat({', '.join(each)}), ',')"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) for every row of `docs`.

    Offsets are code points, ends exclusive. Base spans are those of the strict kinds, and the counts are theirs;
    n_spans counts base and added ones. Added spans have kinds of their own and follow in `spans`, without those that
    meet a base span. Null texts are empty. Repeated rows come out as often as they came in; other columns are ignored; an empty table gives no rows.
    """
    found = written(voted(spans(docs, id_col, text_col)), "spans")
    # at most len(ADDED) * 3 ** len(LABELERS) rows
    patterns = found.select(F.explode("candidates").alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = classifier(sorted((r.k, tuple(r.v), r.n) for r in patterns))
    by_kind = f"element_at(array({', '.join(f'{w!r}D' for w in weights[: len(ADDED)].tolist())}), x.k + 1)"
    by_vote = " + ".join(f"{w!r}D * case x.v[{j}] when 1 then 1 when 0 then -1 else 0 end" for j, w in enumerate(weights[len(ADDED) :].tolist()))
    out = found.withColumn("taken", F.expr(f"filter(candidates, x -> {by_kind} + {by_vote} > 0)"))
    base = [(k, k) for k in BASE]
    added = [(k, f"filter(taken, y -> y.k = {i})") for i, k in enumerate(ADDED)]
    counts: list[Column] = [F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]
    spelled = F.expr(f"array_join(filter(array({joined(base)}, {joined(added)}), x -> x <> ''), ',')")
    return out.select("doc_id", *counts, F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), spelled.alias("spans"), F.size("taken").cast("bigint").alias("n_added"), (sum(counts, F.lit(0)) + F.size("taken")).cast("bigint").alias("n_spans"))
