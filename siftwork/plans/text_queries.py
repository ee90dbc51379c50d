"""Queries over texts, files, identifiers, encryption and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..operators import records as C
from ..operators import structure as R
from ..sources import files as X
from . import stand_ins as T

KEY = "key"
KEYWORDS = ["the", "die", "que", "de", "el"]


def identifier_hash(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.identifier_hash(F.col("source")).alias("source_id"), S.identifier_hash(F.col("text")).alias("text_id"))


def byte_entropy(spark, sf_dir):
    e = T.table(spark, sf_dir, "documents").select("doc_id", S.byte_entropy(F.col("text")).alias("e"))
    return e.select("doc_id", F.round("e", 6).alias("entropy"), (F.col("e") > R.ENTROPY_HIGH).alias("high"))


def line_stats(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", S.line_stats(F.col("text")).alias("s"), S.newline_count(F.col("text")).alias("newlines"))
    return d.select("doc_id", "s.total", "s.blank", "s.blank_ratio", "newlines")


def strip_markup(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(S.strip_comments(F.col("html"), False)).alias("without_comments"), F.sha2(S.strip_strings(S.strip_comments(F.col("html"), False)), 256).alias("clean"), F.sha2(S.strip_strings(S.strip_comments(F.col("html"), True)), 256).alias("clean_hash_style"))


def keyword_complexity(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.keyword_complexity(F.col("text"), KEYWORDS).alias("complexity"))


def magnitude_class(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.groupBy(S.magnitude_class(F.col("o_totalprice")).alias("magnitude"), S.magnitude_class(F.col("o_orderkey") * 1000).alias("key_magnitude")).agg(F.count("*").alias("n"))


def parser_dispatch(spark, sf_dir):
    f = T.files(spark, sf_dir)
    ext = F.col("file_extension")
    parser = S.choose(ext, L.PARSERS)
    return f.select("doc_id", "file_extension", parser.alias("parser"), F.coalesce(S.choose(ext, L.LANGUAGES), ext).alias("language"), ext.isin(*L.ALLOWED).alias("allowed"), F.when(parser.isNull(), F.lit("unsupported_extension")).alias("error"))


def quarantine(spark, sf_dir):
    good, bad = X.checked_extension(T.files(spark, sf_dir))
    one = lambda d, k: d.groupBy("file_extension").agg(F.count("*").alias("n")).withColumn("kept", F.lit(k))
    return one(good, True).union(one(bad, False))


def language_summary(spark, sf_dir):
    f = T.files(spark, sf_dir)
    label = F.coalesce(S.choose(F.col("file_extension"), L.LANGUAGES), F.col("file_extension"))
    return f.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("languages"), F.count("*").alias("files"))


def supported_extensions(spark, sf_dir):
    """Each extension that has a parser or occurs: the parser, if any, and how many files would go to it."""
    seen = T.files(spark, sf_dir).groupBy(F.lower("file_extension").alias("extension")).agg(F.count("*").alias("files"))
    known = F.broadcast(spark.createDataFrame(sorted(L.PARSERS.items()), "extension string, parser string"))  # under 100 rows
    return seen.join(known, "extension", "full").select("extension", "parser", F.coalesce("files", F.lit(0)).alias("files"))


#: A grammar of a caller's own: functions, classes, imports, control words and five flags.
LUA = (r"\bfunction\s+(\w+)", None, r"\brequire\b", "if for while", r"\bloadstring\b", r"\bdofile\b", r"\brequire\b", r"\bsocket\b", r"\bopen\b")


def own_grammar(spark, sf_dir):
    """Sources in a language that a caller adds, made from each document's number, beside one that nobody knows."""
    n = F.col("doc_id")
    times = lambda text, k: F.repeat(F.lit(text), (n % k).cast("int"))
    source = F.concat(times("function f(a)\nend\n", 5), times("local x = require(1)\n", 3), times("if a then b() end\n", 4), times("for i = 1, 2 do end\n", 2))
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.when(n % 7 == 0, "unknown").otherwise("lua").alias("language"), source.alias("text"))
    return R.parse_text(d, grammars={"lua": LUA}).select("doc_id", "function_count", "import_count", "control_count", "has_dynamic_imports", "parse_error")


def regex_structure(spark, sf_dir):
    """Every page read in the nine languages in turn, by page_id."""
    names = list(L.GRAMMARS)
    # pages are long and the parsers' work is by character: more tasks than the table's bytes would get
    p = T.table(spark, sf_dir, "pages").repartition(spark.sparkContext.defaultParallelism).withColumn("language", F.get(F.array(*map(F.lit, names)), (F.col("page_id") % len(names)).cast("int")))
    out = R.parse_text(p, text="html", ascii_only=True)
    return out.select("page_id", "language", "function_count", "class_count", "import_count", "cyclomatic_complexity", "node_count", "depth", "has_exec_calls", "has_eval_calls", "has_dynamic_imports", "has_network_calls", "has_file_io")


def repo_address(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", S.repo_of(F.col("url")).alias("r")).select("page_id", "r.owner", "r.repo")


def file_listing(spark, sf_dir):
    f = T.files(spark, sf_dir).select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.col("file_extension")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "tree").otherwise("blob").alias("type"), F.col("n_chars").alias("size"), "doc_id")
    return X.listing(f, "doc_id", 500, 8000).select("doc_id", "path", "size", "extension")


def fetch_counters(spark, sf_dir):
    f = T.files(spark, sf_dir).select(F.when(F.col("doc_id") % 11 != 0, F.encode("text", "UTF-8")).alias("content"), F.octet_length("text").alias("file_size_bytes"))
    return X.fetch_counters(f)


def sealed_files(spark, sf_dir):
    """Encrypted with a key of its own for each file, and opened again."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    kek, dek = F.lit(bytes(range(32))), F.unhex(F.sha2(F.concat_ws(":", F.lit("dek"), F.col("doc_id")), 256))
    s = d.withColumn("sealed", S.seal(F.col("content"), dek, kek))
    return s.select("doc_id", (S.unseal(F.col("sealed"), kek) == F.col("content")).alias("opens"), (F.length(F.col("sealed.ciphertext")) - F.length("content")).alias("overhead"), (F.length("sealed.ciphertext_sha256") == 64).alias("hashed"), (F.unbase64(F.base64("sealed.wrapped")) == F.col("sealed.wrapped")).alias("base64_round_trip"))


def signed_messages(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.signature(KEY, F.col("role"), F.col("turn"), F.col("text")).alias("signature"))


def replay_window(spark, sf_dir):
    e = T.events(spark, sf_dir)
    now = F.lit(1704070800)
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return e.select("event_id", S.fresh(at, now, 600, 300).alias("fresh"), (now - at > 600).alias("stale"))


def messages(spark, sf_dir):
    """Conversation turns as signed messages to a gateway at second 10000; some are late, early, forged or badly dated."""
    c, i = T.table(spark, sf_dir, "conversations"), F.col("conv_id")
    text = F.when(F.col("turn") % 9 == 8, "").otherwise(F.col("text"))
    at = F.when(i % 13 == 5, "soon").otherwise((F.lit(10000) - (i % 75) + 8).cast("string"))
    expiry = F.when(F.col("turn") % 4 == 3, "9999.5").when(F.col("turn") % 7 == 5, "never").when(F.col("turn") % 2 == 0, "10000")
    m = c.select("conv_id", "turn", F.col("role").alias("sender"), text.alias("payload"), at.alias("ts"), expiry.alias("token_expires"))
    return m.withColumn("signature", S.signature(KEY, F.when(i % 11 == 3, "other").otherwise(F.col("sender")), F.col("ts"), F.col("payload")))


def gateway_verdict(spark, sf_dir):
    """The first thing wrong with a message, in a fixed order, counted."""
    verdict = C.gateway(["user", "assistant"], KEY, F.lit(10000), most=300)
    return messages(spark, sf_dir).groupBy(F.coalesce(verdict, F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


def agent_tokens(spark, sf_dir):
    """Tokens that are right, tampered with, expired or malformed, checked with their mac."""
    c = T.table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.concat(F.lit("agent"), F.col("c_nationkey").cast("string"))
    made = C.token(KEY, name, F.col("c_name"), k % 100, 50)
    given = F.when(k % 7 == 1, F.concat(made, F.lit("0"))).when(k % 7 == 2, "junk").when(k % 7 == 3, F.replace(made, F.lit("agent"), F.lit("agenT"))).otherwise(made)
    return c.select("c_custkey", given.alias("token"), C.token_valid(given, F.lit(100), KEY).alias("valid"))


def decoded_text(spark, sf_dir):
    """Texts of bytes with a stray byte before them and a cut character behind."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    broken = F.concat(F.lit(b"\xff"), "b", F.lit(b"\xc3"))
    return d.select("doc_id", F.sha2(S.text_of(broken), 256).alias("repaired"), (S.text_of(F.col("b")).cast("binary") == F.col("b")).alias("kept"), S.decode_utf8(broken).isNull().alias("refused"))


def routed_messages(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.struct(F.when(F.col("turn") % 4 != 3, F.col("role")).alias("message_type")).alias("header"), F.col("text")))
    return X.routed(c.withColumn("body", body)).groupBy("message_type", "accepted").agg(F.count("*").alias("n"))


def json_property(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return e.groupBy((k % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


QUERIES = {
    "identifier_hash": identifier_hash, "byte_entropy": byte_entropy, "line_stats": line_stats, "strip_markup": strip_markup, "keyword_complexity": keyword_complexity, "magnitude_class": magnitude_class, "parser_dispatch": parser_dispatch, "quarantine": quarantine, "language_summary": language_summary, "supported_extensions": supported_extensions, "own_grammar": own_grammar,
    "regex_structure": regex_structure, "repo_address": repo_address, "file_listing": file_listing, "fetch_counters": fetch_counters, "sealed_files": sealed_files, "signed_messages": signed_messages, "agent_tokens": agent_tokens, "decoded_text": decoded_text, "replay_window": replay_window, "gateway_verdict": gateway_verdict,
    "routed_messages": routed_messages, "json_property": json_property,
}


def _hmac(text: str, key: str) -> str:
    pads = ["".join(f"{c ^ pad:02x}" for c in key.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({text}))))"


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _structure() -> str:
    parts = []
    for i, (name, (func, cls, imp, control, *flags)) in enumerate(L.GRAMMARS.items()):
        count = lambda p: f"len(regexp_extract_all(t, {_quoted(p)}))" if p else "0"
        hits = " + ".join(count(rf"\b{w}\b") for w in control.split())
        src = "st_hash" if name in L.HASH_COMMENTS else "st_c"
        tests = ", ".join(f"regexp_matches(t, {_quoted(p)}) AS {k}" for p, k in zip(flags, ("has_exec_calls", "has_eval_calls", "has_dynamic_imports", "has_network_calls", "has_file_io")))
        parts.append(f"SELECT page_id, '{name}' AS language, {count(func)} AS function_count, {count(cls)} AS class_count, {count(imp)} AS import_count, {hits} AS hits, {tests} FROM (SELECT page_id, {src} AS t FROM st WHERE page_id % {len(L.GRAMMARS)} = {i})")
    return STRIP + ", u AS (" + " UNION ALL ".join(parts) + ") SELECT page_id, language, function_count, class_count, import_count, hits + 1 AS cyclomatic_complexity, 1 + function_count + class_count + import_count + hits AS node_count, least(3 + function_count // 5, 20) AS depth, has_exec_calls, has_eval_calls, has_dynamic_imports, has_network_calls, has_file_io FROM u"


def _strings(x: str) -> str:
    for p, r in (('"""(?s:.*?)"""', '""'), ("'''(?s:.*?)'''", "''"), ("`[^`]*`", "``"), (r'"(?:[^"\\]|\\.)*"', '""'), (r"'(?:[^'\\]|\\.)*'", "''")):
        x = f"regexp_replace({x}, {_quoted(p)}, {_quoted(r)}, 'g')"
    return x


C_STYLE = r"regexp_replace(regexp_replace(html, '/\*(?s:.*?)\*/', '', 'g'), '//[^\n]*', '', 'g')"
STRIP = f"WITH st AS (SELECT page_id, {C_STYLE} AS c, {_strings(C_STYLE)} AS st_c, {_strings(chr(114) + 'egexp_replace(html, ' + _quoted('#[^' + chr(92) + 'n]*') + ', ' + _quoted('') + ', ' + _quoted('g') + ')')} AS st_hash FROM pages)"
FS = "WITH " + T.FILES_SQL
ORACLE_SQL = {
    "identifier_hash": "SELECT doc_id, 'ID_' || substr(sha256(source), 1, 8) AS source_id, 'ID_' || substr(sha256(text), 1, 8) AS text_id FROM documents",
    "byte_entropy": "WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY ALL), e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY 1) SELECT doc_id, round(coalesce(e, 0.0), 6) + 0.0 AS entropy, coalesce(e, 0.0) > 5.2 AS high FROM documents LEFT JOIN e USING (doc_id)",
    "line_stats": "WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, text, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM a) SELECT doc_id, len(p) AS total, len(list_filter(p, lambda x: regexp_full_match(x, '\\s*'))) AS blank, CAST(len(list_filter(p, lambda x: regexp_full_match(x, '\\s*'))) AS DOUBLE) / greatest(len(p), 1) AS blank_ratio, length(text) - length(replace(text, chr(10), '')) + 1 AS newlines FROM l",
    "strip_markup": STRIP + " SELECT page_id, length(c) AS without_comments, sha256(st_c) AS clean, sha256(st_hash) AS clean_hash_style FROM st",
    "keyword_complexity": f"SELECT doc_id, 1 + len(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda x: x IN ({', '.join(map(_quoted, KEYWORDS))}))) AS complexity FROM documents",
    "magnitude_class": "WITH m AS (SELECT o_totalprice AS a, o_orderkey * 1000 AS b FROM orders) SELECT " + ", ".join(f"CASE WHEN abs({c}) = 0 THEN 'zero' WHEN abs({c}) < 256 THEN 'byte_range' WHEN abs({c}) < 65536 THEN 'word_range' WHEN abs({c}) < 4294967296 THEN 'dword_range' ELSE 'large' END AS {n}" for c, n in (("a", "magnitude"), ("b", "key_magnitude"))) + ", count(*) AS n FROM m GROUP BY ALL",
    "parser_dispatch": FS + f" SELECT doc_id, file_extension, {_case('file_extension', L.PARSERS)} AS parser, coalesce({_case('file_extension', L.LANGUAGES)}, file_extension) AS language, file_extension IN ({', '.join(map(_quoted, L.ALLOWED))}) AS allowed, CASE WHEN {_case('file_extension', L.PARSERS)} IS NULL THEN 'unsupported_extension' END AS error FROM fs",
    "quarantine": FS + f" SELECT file_extension, count(*) AS n, file_extension IN ({', '.join(map(_quoted, L.ALLOWED))}) AS kept FROM fs GROUP BY ALL",
    "language_summary": FS + f" SELECT source, array_to_string(list_sort(list(DISTINCT coalesce({_case('file_extension', L.LANGUAGES)}, file_extension))), ',') AS languages, count(*) AS files FROM fs GROUP BY source",
    "own_grammar": "SELECT doc_id, CASE WHEN k THEN doc_id % 5 END AS function_count, CASE WHEN k THEN doc_id % 3 END AS import_count, CASE WHEN k THEN doc_id % 4 + doc_id % 2 END AS control_count, CASE WHEN k THEN doc_id % 3 > 0 END AS has_dynamic_imports, CASE WHEN NOT k THEN 'unsupported_extension' END AS parse_error FROM (SELECT *, doc_id % 7 <> 0 AS k FROM documents)",
    "supported_extensions": "WITH " + T.FILES_SQL + ", k(extension, parser) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.PARSERS.items()) + "), f AS (SELECT lower(file_extension) AS extension, count(*) AS files FROM fs GROUP BY 1) SELECT coalesce(f.extension, k.extension) AS extension, parser, coalesce(files, 0) AS files FROM f FULL JOIN k ON k.extension = f.extension",
    "regex_structure": _structure(),
    "repo_address": "WITH p AS (SELECT page_id, string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS x FROM pages) SELECT page_id, x[1] AS owner, regexp_replace(x[2], '\\.git$', '') AS repo FROM p",
    "file_listing": FS + f" SELECT doc_id, 'src/f' || doc_id || file_extension AS path, n_chars AS size, file_extension AS extension FROM fs WHERE doc_id % 7 <> 0 AND n_chars <= 8000 AND file_extension IN ({', '.join(map(_quoted, L.PARSERS))}) ORDER BY doc_id LIMIT 500",
    "fetch_counters": "SELECT count(*) AS files_fetched, count(*) FILTER (doc_id % 11 <> 0) AS files_encrypted, sum(octet_length(encode(text))) AS bytes_fetched, count(*) FILTER (doc_id % 11 = 0) AS errors FROM documents",
    "sealed_files": "SELECT doc_id, true AS opens, 28 AS overhead, true AS hashed, true AS base64_round_trip FROM documents",
    "replay_window": "WITH e AS (SELECT event_id, 1704070800 - CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS age FROM events) SELECT event_id, age <= 600 AND age >= -300 AS fresh, age > 600 AS stale FROM e",
    "signed_messages": "SELECT conv_id, turn, " + _hmac("role || ':' || turn || ':' || sha256(text)", "key") + " AS signature FROM conversations",
    "gateway_verdict": "WITH c AS (SELECT *, CASE WHEN turn % 9 = 8 THEN '' ELSE text END AS p, conv_id % 75 - 8 AS age FROM conversations) SELECT CASE WHEN role NOT IN ('user', 'assistant') THEN 'UnknownSender' WHEN turn % 4 = 3 THEN 'TokenExpired' WHEN conv_id % 13 = 5 THEN 'SignatureMismatch' WHEN age > 60 OR age < -5 THEN 'SignatureExpired' WHEN conv_id % 11 = 3 THEN 'SignatureMismatch' WHEN p = '' THEN 'EmptyPayload' WHEN octet_length(encode(p)) > 300 THEN 'PayloadTooLarge' ELSE 'ok' END AS verdict, count(*) AS n FROM c GROUP BY 1",
    "agent_tokens": "WITH b AS (SELECT c_custkey, 'agent' || c_nationkey || '|' || c_name || '|' || (c_custkey % 100 + 50) AS body FROM customer), t AS (SELECT c_custkey, body, body || '|' || substr(" + _hmac("body", "key") + ", 1, 16) AS made FROM b) SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN made || '0' WHEN 2 THEN 'junk' WHEN 3 THEN replace(made, 'agent', 'agenT') ELSE made END AS token, c_custkey % 7 NOT IN (1, 2, 3) AND c_custkey % 100 + 50 > 100 AS valid FROM t",
    "decoded_text": "SELECT doc_id, sha256(chr(65533) || text || chr(65533)) AS repaired, true AS kept, true AS refused FROM documents",
    "routed_messages": "SELECT CASE WHEN turn % 4 <> 3 THEN role END AS message_type, turn % 4 <> 3 AS accepted, count(*) AS n FROM conversations GROUP BY ALL",
    "json_property": "WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT k % 10 AS digit, count(*) AS n, sum(k) AS total FROM e GROUP BY 1",
}
