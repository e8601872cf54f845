"""DuckDB SQL for the queries of the registry, over the same tables.

Lookahead and lookbehind don't exist there; where a query needs them it is tested on fixtures, or units are taken by
matching in place of splitting. Classes that are Unicode-aware in Spark are spelled out.
"""

from __future__ import annotations

from .. import config
from ..functions import markdown as M
from ..operators import hybrid

WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
TOKEN = "[A-Za-z0-9_]+|[一-鿿]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, {q(old)}, {q(new)})"
    return c


def rx(c: str, pattern: str, new: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"


def strip(c: str) -> str:
    return rx(c, rf"\A[{WS}]+|[{WS}]+\z", "")


SPACED = "replace(content, chr(10), chr(10) || chr(10))"


def found(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))::INT"


def level(t: str) -> str:
    """The level of a title."""
    bad = " OR ".join(f"regexp_matches({t}, {q(p)})" for p in (
        r"(?i)^(int|void|char|float|double|boolean|typedef|struct|enum|class|const|static)", rf"^[a-zA-Z_][{WORD}]*[{WS}]*[\[\(=;]", rf"^[\p{{Nd}}{WS}]+[）\)]$",
        r"^[}{\[\];,\(\)]+$", rf"^\p{{Nd}}+[{WS}]*(退出区|剩余区|临界区)", r"(?i)^(while|for|if|return)",
    ))
    valid = rf"(NOT ({bad}) AND length({t}) >= 2 AND NOT regexp_matches({t}, {q(rf'^[^{WORD}]+$')}) AND NOT regexp_matches({t}, {q(rf'^([\p{{Nd}}{WS}]|[^{WORD}])+$')}))"
    tests = ((rf"^第[{WS}]*[0-9０-９]+[{WS}]*章", 1), (r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+", 4), (r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+", 3), (r"^\p{Nd}+\.\p{Nd}+", 2), (r"^\p{Nd}+[．\.][一-龥]", 4), (rf"^\p{{Nd}}+[．\.{WS}]", 2))
    case = " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {n}" for p, n in tests)
    return valid, f"(CASE WHEN NOT {valid} THEN 0 {case} ELSE 3 END)"


def _cleaning() -> dict[str, str]:
    steps = {
        "garbage": replaced("content", [(g, "") for g in M.GARBAGE]),
        "join_chapter": rx(SPACED, rf"## (第\p{{Nd}}+章)[{WS}]*\n+## ([^\n]+)", r"## \1 \2"),
        "image": replaced("content", [("<!-- image -->", M.IMAGE)]),
        "after_image": rx(SPACED, r"(> 📷 \*\*\[图片\]\*\*.*?\n\n)([^\n#]{1,15}\n\n)", r"\1"),
        "isolated_han": rx(SPACED, r"\n\n([一-龥]{1,10})\n\n", "\n\n"),
        "running_titles": replaced(SPACED, [(f"\n\n{t}\n\n", "\n\n") for t in M.RUNNING_TITLES]),
        "isolated_number": rx(SPACED, r"\n\n(\p{Nd}{1,4})\n\n", "\n\n"),
        "isolated_chapter": rx(SPACED, rf"\n\n(第[{WS}]*\p{{Nd}}+[{WS}]*章)\n\n", "\n\n"),
        "fragments": rx(SPACED, rf"\n\n([^\n#]{{1,10}})\n\n({M.OPENERS})", "\n\n\\2"),
        "circled": replaced("content", M.CIRCLED),
        "dot": rx("content", r"(\p{Nd}+)．", r"\1."),
        "entities": replaced("content", M.ENTITIES),
        "underscore": replaced("content", [("\\_", "_")]),
        "blank": rx(rx(SPACED, r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", ""),
        "trim": f"regexp_replace({SPACED}, '^\\n+|\\n+$', '', 'g') || chr(10)",
    }
    spacing = "content"
    for p in (r"([^\n])\n(#{1,4} )", r"(#{1,4} [^\n]+)\n([^\n#])", r"([^\n])\n(```)", r"(```)\n([^\n`])"):
        spacing = rx(spacing, p, "\\1\n\n\\2")
    steps["spacing"] = rx(spacing, r"\n{3,}", "\n\n")
    out = {f"clean_{k}": f"SELECT row_id, {v} AS text FROM chunks" for k, v in steps.items()}
    out["clean_code"] = (
        "SELECT row_id, array_to_string(list_transform(p, lambda s, i: CASE WHEN i % 2 = 0 AND i < len(p) THEN translate(s, '；，（）', ';,()') ELSE s END), '```') AS text "
        "FROM (SELECT row_id, string_split(content, '```') AS p FROM chunks)"
    )
    bare = strip("x")
    title = rx(bare, rf"\A#+[{WS}]*", "")
    _, lv = level("t")
    out["clean_headings"] = (
        f"WITH l AS (SELECT row_id, i, x, {title} AS t, starts_with({bare}, '#') AS h FROM (SELECT row_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT row_id, string_split(content, chr(10)) AS s FROM chunks)))"
        f" SELECT c.row_id, r.text FROM chunks c LEFT JOIN (SELECT row_id, string_agg(CASE WHEN NOT h THEN x WHEN {lv} = 0 THEN t ELSE repeat('#', {lv}) || ' ' || t END, chr(10) ORDER BY i) AS text FROM l GROUP BY row_id) r USING (row_id)"
    )
    return out


VALID, LEVEL = level("section_h2")
DOCS = "(SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE text IS NOT NULL)"
HEAD = rf"^(#{{1,4}})[{WS}]+(.+)$"
#: The sections of the documents with a body, in order.
SECTIONS = f"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {DOCS})),
h AS (SELECT *, regexp_matches(x, {q(HEAD)}) AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
s AS (SELECT doc_id, no, coalesce(max(CASE WHEN head THEN length(regexp_extract(x, {q(HEAD)}, 1)) END), 0) AS level,
  coalesce(max(CASE WHEN head THEN {strip(f"regexp_extract(x, {q(HEAD)}, 2)")} END), '') AS title,
  string_agg(x, chr(10) ORDER BY i) FILTER (NOT head AND regexp_matches(x, {q(rf"[^{WS}]")})) AS content
  FROM g GROUP BY doc_id, no),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no)::INT AS n, level::INT AS level, title, content FROM s WHERE content IS NOT NULL)
"""
CARRIED = SECTIONS + """,
p AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS p1, max(CASE WHEN level = 2 THEN n END) OVER w AS p2, max(CASE WHEN level = 3 THEN n END) OVER w AS p3,
  max(CASE WHEN level = 4 THEN n END) OVER w AS p4, sum((level = 1)::INT) OVER w AS chapter_num FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT p.doc_id, p.n, p.level, p.content, p.chapter_num::INT AS chapter_num, coalesce(a.title, '') AS chapter,
  CASE WHEN p2 > coalesce(p1, -1) THEN b.title ELSE '' END AS section_h2, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN d.title ELSE '' END AS section_h3,
  CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN e.title ELSE '' END AS section_h4
  FROM p LEFT JOIN k a ON a.doc_id = p.doc_id AND a.n = p1 LEFT JOIN k b ON b.doc_id = p.doc_id AND b.n = p2 LEFT JOIN k d ON d.doc_id = p.doc_id AND d.n = p3 LEFT JOIN k e ON e.doc_id = p.doc_id AND e.n = p4)
"""


def units(c: str) -> str:
    return f"regexp_extract_all({c}, {q('[^。！？\n]*[。！？\n]|[^。！？\n]+')})"


def packed(c: str) -> str:
    """The pieces of a text as a list."""
    start = f"list_transform({units(c)}, lambda u: {{'done': []::VARCHAR[], 'cur': u}})"
    step = f"lambda a, b: CASE WHEN length(a.cur) + length(b.cur) > {config.MAX_CHUNK} THEN {{'done': CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END, 'cur': b.cur}} ELSE {{'done': a.done, 'cur': a.cur || b.cur}} END"
    return f"(list_reduce({start}, {step}))"


def pieces(c: str) -> str:
    r = packed(c)
    return f"CASE WHEN {r}.cur <> '' THEN list_append({r}.done, {r}.cur) ELSE {r}.done END"


FOUND = "regexp_extract(chapter, '第[" + WS + r"]*(\p{Nd}+)[" + WS + "]*章', 1)"
H2_NO = r"replace(regexp_extract(section_h2, '^(\p{Nd}+\.\p{Nd}+)', 1), '.', '_')"
SPLIT = CARRIED + f""",
b AS (SELECT *, CASE WHEN length(content) > {config.MAX_CHUNK} AND NOT regexp_matches(content, {q(rf"\A[{WS}]*<table")}) THEN {pieces("content")} ELSE [content] END AS parts
  FROM c WHERE length({strip("content")}) >= {config.MIN_BODY}),
u AS (SELECT * EXCLUDE (parts, content), generate_subscripts(parts, 1) AS part, unnest(parts) AS piece FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, part)::INT AS ordinal FROM u),
f AS (SELECT doc_id, ordinal, 'ch' || CASE WHEN {FOUND} <> '' THEN {FOUND} ELSE chapter_num::VARCHAR END || CASE WHEN {H2_NO} <> '' THEN '_s' || {H2_NO} ELSE '' END || '_p' || printf('%03d', ordinal) AS chunk_id,
  chapter, section_h2, {strip("piece")} AS content, level, length(piece)::INT AS char_count, contains(piece, '```') AS has_code, (contains(piece, '📷') OR contains(piece, '[图片]')) AS has_image FROM o)
"""


def merged(rows: str, names: tuple[str, ...]) -> str:
    """Small chunks merged; rows gives doc_id, ordinal and the columns."""
    item = "{" + ", ".join(f"'{n}': {n}" for n in names) + "}"
    new = {"content": "a.cur.content || chr(10) || chr(10) || b.cur.content", "has_code": "(a.cur.has_code OR b.cur.has_code)", "has_image": "(a.cur.has_image OR b.cur.has_image)", "char_count": "(length(a.cur.content) + 2 + length(b.cur.content))::INT"}
    join = "{" + ", ".join(f"'{n}': {new.get(n, f'a.cur.{n}')}" for n in names) + "}"
    wrapped = "list_transform(items, lambda x: {'done': list_filter(items, lambda y: false), 'cur': x})"
    none = "{'done': list_filter(items, lambda y: false), 'cur': list_extract(items, 0)}"
    step = (
        f"lambda a, b: CASE WHEN b.cur.char_count >= {config.MIN_CHUNK} THEN {{'done': CASE WHEN a.cur.char_count IS NOT NULL THEN list_append(a.done, a.cur) ELSE a.done END, 'cur': b.cur}} "
        f"WHEN a.cur.char_count IS NOT NULL AND a.cur.char_count + b.cur.char_count + {config.JOIN_CHARS} <= {config.MAX_CHUNK} THEN {{'done': a.done, 'cur': {join}}} ELSE a END"
    )
    return f"""i AS (SELECT doc_id, list({item} ORDER BY ordinal) AS items FROM {rows} GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(list_concat([{none}], {wrapped}), {step}) AS z FROM i),
m AS (SELECT doc_id, unnest(CASE WHEN z.cur.char_count IS NOT NULL THEN list_append(z.done, z.cur) ELSE z.done END) AS y FROM r)"""


CHUNK = ("ordinal", "chunk_id", "chapter", "section_h2", "content", "level", "char_count", "has_code", "has_image")
SMALL = ("ordinal", "chunk_id", "content", "char_count", "has_code", "has_image")
ISSUES = f"""(SELECT row_id, list_filter([
  CASE WHEN has_code AND (starts_with({strip("content")}, '```' || chr(10) || chr(10) || '}}') OR starts_with({strip("content")}, '```' || chr(10) || chr(10) || ')')) THEN 'code_truncated' END,
  CASE WHEN regexp_matches(content, {q(rf"(?m)^[{WS}]*\p{{Nd}}+[{WS}]+[a-zA-Z_][{WORD}]*[{WS}]*\(")}) THEN 'has_line_numbers' END,
  CASE WHEN char_count < {config.ISSUE_SMALL} THEN 'too_small' WHEN char_count > {config.ISSUE_LARGE} THEN 'too_large' END,
  CASE WHEN has_code AND regexp_matches(content, '(?s)```.*?```') AND length(regexp_extract(content, '(?s)```.*?```')) < {config.EMPTY_CODE} THEN 'empty_code' END], lambda x: x IS NOT NULL) AS issues FROM chunks)"""
STATUS = "CASE WHEN {0} < 5 THEN 'excellent' WHEN {0} < 15 THEN 'good' ELSE 'poor' END"
# isnan() is folded away there by column statistics that leave NaN out; the text of the number isn't
SCORES = "(SELECT pair_id::BIGINT AS pair_id, " + ", ".join(f"nullif({m}::VARCHAR, 'nan')::DOUBLE AS {m}" for m in ("faithfulness", "context_precision", "answer_relevancy", "context_recall")) + " FROM eval_scores)"
LONG = "(" + " UNION ALL ".join(f"SELECT pair_id, '{m}' AS metric, {m} AS score FROM {SCORES}" for m in ("faithfulness", "context_precision", "answer_relevancy", "context_recall")) + ")"
VEC = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings)"
SIMS = f"(SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS similarity FROM {VEC} a, {VEC} b WHERE a.vec_id % 20 = 0)"


def knn(source: str, k: int, parts: str = "query_id") -> str:
    return f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY {parts} ORDER BY similarity DESC, vec_id)::INT AS rank FROM {source} QUALIFY rank <= {k}"


def asked(per_book: str, every: bool = False) -> str:
    """The questions asked: every one, or those whose id is divisible by 20; c: how many chunks each takes from a book."""
    some = "" if every else "question_id % 20 = 0 AND "
    return f"asked AS (SELECT *, {per_book} AS c FROM (SELECT question_id AS query_id, min(question) AS query, min(book_name) AS book_name FROM eval_questions WHERE {some}question IS NOT NULL GROUP BY 1))"


BM25 = f"""
t AS (SELECT book_name AS grp, row_id, regexp_extract_all(content, {q(TOKEN)}) AS w FROM chunks WHERE content IS NOT NULL AND book_name IS NOT NULL),
dl AS (SELECT grp, row_id, len(w) AS dl FROM t),
tf AS (SELECT grp, row_id, term, count(*) AS tf FROM (SELECT grp, row_id, unnest(w) AS term FROM t) GROUP BY ALL),
gs AS (SELECT grp, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY grp),
rw AS (SELECT grp, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf JOIN gs USING (grp) GROUP BY grp, term),
mi AS (SELECT grp, avg(raw) AS m FROM rw GROUP BY grp),
idf AS (SELECT grp, term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM rw JOIN mi USING (grp))
"""


def scored(scoped: bool, digits: int = 6, per_book: str = str(config.TOP_K), every: bool = False) -> str:
    match = "(book_name IS NULL OR book_name = grp)" if scoped else "TRUE"
    return f"""{BM25}, {asked(per_book, every)},
qt AS (SELECT query_id, book_name, term, count(*) AS times FROM (SELECT query_id, book_name, unnest(regexp_extract_all(query, {q(TOKEN)})) AS term FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, grp, row_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), {digits}) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (grp, term) JOIN dl USING (grp, row_id) JOIN gs USING (grp) WHERE {match} GROUP BY ALL),
al AS (SELECT query_id, grp, row_id, coalesce(score, 0.0::DOUBLE) AS score FROM (SELECT query_id, grp, row_id FROM asked, dl WHERE {match}) LEFT JOIN sc USING (query_id, grp, row_id))"""


NOISY = f"(regexp_matches(coalesce(section_h2, ''), {q(hybrid.NOISE)}) OR coalesce(char_count, 0) <= {config.MIN_HIT_CHARS})"


BAG = "(SELECT {id}, b, count(*)::DOUBLE AS n FROM (SELECT {id}, unicode(unnest(regexp_extract_all({text}, '[一-鿿a-zA-Z]'))) % 64 AS b FROM {table}) GROUP BY ALL)"


def fused(prefilter: bool = False, dedupe: bool = False, per_book: str = str(config.TOP_K), times: int = 1, query: str = "query", every: bool = False) -> str:
    """Both branches of the hybrid search, weighted. per_book: chunks that a question takes from a book; times: candidates for each; query: what is encoded; every: for all questions."""
    where = f"AND NOT {NOISY}" if prefilter else ""
    once = "QUALIFY row_number() OVER (PARTITION BY query_id, book_name, row_id ORDER BY final_score DESC, source, rank) = 1" if dedupe else ""
    return f"""WITH {scored(True, 9, per_book, every)},
kw AS (SELECT query_id, grp AS book_name, row_id, score * {config.BM25_SCALE}::DOUBLE AS similarity, c, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, row_id) AS rank FROM al JOIN (SELECT query_id, c FROM asked) USING (query_id) QUALIFY rank <= c * {times}),
cv AS {BAG.format(id="row_id", text="content", table="chunks")}, qv AS {BAG.format(id="query_id", text=query, table="asked")},
cn AS (SELECT row_id, sqrt(sum(n * n)) AS l FROM cv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM qv GROUP BY 1),
dp AS (SELECT query_id, row_id, sum(qv.n * cv.n) AS d FROM qv JOIN cv USING (b) GROUP BY ALL),
sm AS (SELECT a.query_id, a.c, c.book_name, c.row_id, c.section_h2, c.char_count, round(coalesce(d / (qn.l * cn.l), 0.0::DOUBLE), 6) AS similarity
  FROM asked a JOIN chunks c ON c.book_name IS NOT NULL AND (a.book_name IS NULL OR a.book_name = c.book_name) {where} LEFT JOIN dp ON dp.query_id = a.query_id AND dp.row_id = c.row_id LEFT JOIN qn ON qn.query_id = a.query_id LEFT JOIN cn ON cn.row_id = c.row_id),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_name ORDER BY similarity DESC, row_id) AS rank FROM sm QUALIFY rank <= c * {times * config.OVERFETCH_VECTOR}),
se AS (SELECT query_id, book_name, row_id, similarity, c, rank FROM sr WHERE NOT {NOISY}),
un AS (SELECT query_id, book_name, row_id, 'embedding' AS method, similarity, c, round(similarity, 9) AS final_score, 0 AS source, rank FROM se
  UNION ALL SELECT query_id, book_name, row_id, 'bm25', similarity, c, round(similarity * {config.WEIGHT_KEYWORD}::DOUBLE, 9), 1, rank FROM kw),
on1 AS (SELECT * FROM un {once}),
fu AS (SELECT query_id, book_name, row_id, method, similarity, final_score, row_number() OVER (PARTITION BY query_id, book_name ORDER BY final_score DESC, source, rank, book_name, row_id)::INT AS place FROM on1 QUALIFY place <= c * {times})"""


def crossed(k: int, every: bool = False) -> str:
    """The k best chunks of each question: those of its own book, or of half as many from each book where it names none."""
    return fused(per_book=f"CASE WHEN book_name IS NULL THEN {max(1, k // 2)} ELSE {k} END", every=every) + f""",
cb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, place, book_name, row_id, method)::INT AS r FROM fu QUALIFY r <= {k})"""


def blocks(similarity: str, method: str) -> str:
    return f"chr(10) || '【参考资料 ' || place || '】（相似度: ' || {similarity} || ' | 方法: ' || {method} || '）' || chr(10) || ' 教材: ' || coalesce(book_name, '') || chr(10) || ' 章节: ' || coalesce(chapter, '') || ' - ' || coalesce(section_h2, '') || chr(10) || ' 内容:' || chr(10) || coalesce(content, '') || chr(10) || '---' || chr(10)"


def prompted(query: str, context: str) -> str:
    return f"{q(hybrid.SYSTEM)} || {q(chr(10) * 2 + '## 学生问题' + chr(10))} || {query} || {q(chr(10) * 2 + '## 相关教材内容' + chr(10))} || {context} || {q(chr(10) * 2 + '请开始你的回答：' + chr(10))}"


def answers(every: bool = False) -> str:
    """The answers, one a question."""
    return crossed(config.TOP_K, every) + f""",
hb AS (SELECT cb.query_id, r AS place, cb.book_name, row_id, method, chapter, chunks.section_h2, content, printf('%.3f', round(similarity, 3)) AS shown FROM cb JOIN chunks USING (row_id)),
bl AS (SELECT *, {blocks("shown", "method")} AS block FROM hb),
rn AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY place) <= {config.CONTEXT_CHARS} AS fits FROM bl),
cx AS (SELECT query_id, coalesce(string_agg(block, '' ORDER BY place) FILTER (fits), '') || CASE WHEN bool_and(fits) THEN '' ELSE {q(hybrid.CUT)} END AS context, string_agg(concat_ws(':', place, book_name, row_id, method), '|' ORDER BY place) AS hits,
  string_agg(concat_ws(' > ', book_name, nullif(chapter, ''), nullif(section_h2, '')), '|' ORDER BY place) FILTER (place <= 3) AS sources FROM rn GROUP BY query_id),
an AS (SELECT a.query_id, coalesce(hits, '') AS hits, coalesce(context, '') AS context, CASE WHEN context IS NULL THEN '' ELSE {prompted("query", "context")} END AS prompt,
  CASE WHEN trim(context) <> '' THEN substr(context, 1, 200) END AS answer, CASE WHEN context IS NOT NULL THEN 'extractive' END AS model, context IS NOT NULL AS found, sources, coalesce(trim(context) <> '', false) AS success FROM asked a LEFT JOIN cx USING (query_id))"""


def verdicts(claims: str, context: str) -> str:
    """The share of a text's sentences that another one bears out."""
    has = f"regexp_extract_all({context}, {q(TOKEN)})"
    sentences = f"list_filter(list_transform(regexp_extract_all({claims}, '[^。！？\n]+'), lambda s: list_distinct(regexp_extract_all(s, {q(TOKEN)}))), lambda t: len(t) > 0)"
    return f"(SELECT pair_id, list_transform({sentences}, lambda t: len(list_intersect(t, {has})) * 2 >= len(t)) AS v FROM qa_comparison)"


def share(name: str, claims: str, context: str) -> str:
    return f"SELECT pair_id, CASE WHEN {context} IS NOT NULL AND len(v) > 0 THEN round(len(list_filter(v, lambda x: x))::DOUBLE / len(v), 6) END AS {name} FROM {verdicts(claims, context)} JOIN qa_comparison USING (pair_id)"


FUSION = "SELECT query_id, book_name, row_id, method, round(final_score, 6) AS final_score, place AS rank FROM fu"
def oracle_sql() -> dict[str, str]:
    k = config.TOP_K
    stats = ", ".join(f"{found(SPACED, rf'(?m)^#{{{n}}} ')} AS h{n}" for n in (1, 2, 3, 4))
    jac = f"len(list_intersect(a, t))::DOUBLE / len(list_distinct(list_concat(a, t)))"
    out = _cleaning()
    out |= {
        "title_level": f"SELECT row_id, {LEVEL}::INT AS level, {VALID} AS valid FROM chunks",
        "section_parse": SECTIONS + "SELECT doc_id, n, level, title, content FROM k",
        "heading_context": CARRIED + "SELECT doc_id, n, chapter, section_h2, section_h3, section_h4, chapter_num FROM c",
        "sentence_pack": f"WITH p AS (SELECT row_id, {pieces('content')} AS l FROM chunks WHERE length(content) > {config.MAX_CHUNK}) SELECT row_id, (generate_subscripts(l, 1) - 1)::INT AS piece, unnest(l) AS text FROM p",
        "section_chunks": SPLIT + "SELECT doc_id, ordinal, chunk_id, content, char_count, has_code, has_image FROM f",
        "chunk_documents": SPLIT + ", " + merged("f", CHUNK) + " SELECT doc_id, " + ", ".join(f"y.{c} AS {c}" for c in CHUNK) + " FROM m",
        "small_merge": "WITH f AS (SELECT stem AS doc_id, row_id AS ordinal, chunk_id, content, length(content)::INT AS char_count, has_code, has_image FROM chunks WHERE stem IS NOT NULL AND content IS NOT NULL), " + merged("f", SMALL) + " SELECT doc_id, " + ", ".join(f"y.{c} AS {c}" for c in SMALL) + " FROM m",
        "chunk_stats": "SELECT count(*) AS chunks, coalesce(sum(char_count), 0)::BIGINT AS chars, round(coalesce(avg(char_count), 0.0), 6) AS mean_chars, count(*) FILTER (has_code) AS with_code, count(*) FILTER (has_image) AS with_image FROM chunks",
        "chunk_level_hist": "SELECT level, count(*) AS chunks FROM chunks GROUP BY level",
        "chunk_flags": "SELECT row_id, contains(content, '```') AS code, (contains(content, '📷') OR contains(content, '[图片]')) AS image FROM chunks",
        "markdown_stats": f"SELECT row_id, {stats}, {found(SPACED, r'\n\n[^\n#].{20,}')} AS paragraphs, {found(SPACED, r'\n\n([^\n#]{1,15})\n\n')} AS isolated, ({found(SPACED, '(?m)^```')} // 2)::INT AS code_blocks, length({SPACED})::INT AS chars FROM chunks",
        "parse_report": f"WITH r AS (SELECT doc_id, length(text)::INT AS chars, len(string_split(text, chr(10)))::INT AS lines, " + ", ".join(f"((length(text) - length(replace(text, {q(s)}, ''))) // {len(s)})::INT AS {n}" for n, s in (("h2", "\n## "), ("h3", "\n### "), ("placeholders", "<!-- image -->"), ("fences", "```"), ("blank_lines", "\n\n"))) + f" FROM {DOCS}) SELECT *, array_to_string(list_filter([CASE WHEN placeholders > 0 THEN 'placeholders' END, CASE WHEN chars < {config.SHORT_DOCUMENT} THEN 'short' END], lambda x: x IS NOT NULL), ',') AS issues FROM r",
        "chunk_issues": f"SELECT row_id, unnest(issues) AS issue FROM {ISSUES}",
        "issue_report": f"WITH i AS (SELECT unnest(issues) AS issue FROM {ISSUES}), n AS (SELECT unnest(['code_truncated', 'has_line_numbers', 'too_small', 'too_large', 'empty_code']) AS issue), c AS (SELECT n.issue, count(i.issue) AS chunks FROM n LEFT JOIN i USING (issue) GROUP BY 1), p AS (SELECT issue, chunks, CASE WHEN t > 0 THEN chunks * 100.0::DOUBLE / t ELSE 0.0::DOUBLE END AS percent FROM c, (SELECT count(*) AS t FROM chunks)) SELECT issue, chunks, round(percent, 6) AS percent, {STATUS.format('percent')} AS status FROM p",
        "quality_grade": f"WITH s AS (SELECT count(*) AS total, coalesce(sum(len(issues)), 0)::BIGINT AS issues FROM {ISSUES}) SELECT total, issues, round(CASE WHEN total > 0 THEN issues * 100.0::DOUBLE / total ELSE 0 END, 6) AS rate, {STATUS.format('(CASE WHEN total > 0 THEN issues * 100.0::DOUBLE / total ELSE 0 END)')} AS grade FROM s",
        "label_histogram": 'SELECT lang, count(*) AS "count" FROM documents WHERE lang IS NOT NULL GROUP BY lang',
        "metric_means": f"SELECT metric, round(avg(score), 6) AS mean, count(score) AS judged, count(*) FILTER (score IS NULL) AS failed FROM {LONG} GROUP BY metric",
        "metric_failures": f"SELECT pair_id, metric FROM {LONG} WHERE score IS NULL",
        "metric_grade": f"WITH m AS (SELECT metric, round(avg(score), 6) AS s FROM {LONG} GROUP BY metric) SELECT metric, CASE WHEN s >= 0.85 THEN '优秀' WHEN s >= 0.7 THEN '良好' WHEN s >= 0.5 THEN '及格' ELSE '需改进' END AS grade, repeat('█', floor(s * 30)::INT) || repeat('░', 30 - floor(s * 30)::INT) AS bar, round_even(s, 3) AS shown, printf('%.4f', s) AS printed FROM m",
        "metric_delta": f"WITH s AS (SELECT metric, run_name = 'baseline' AS base, score FROM {LONG} JOIN qa_comparison USING (pair_id) WHERE run_name IS NOT NULL), m AS (SELECT metric, avg(score) FILTER (NOT base) AS a, avg(score) FILTER (base) AS b FROM s GROUP BY 1) SELECT metric, round(a, 6) AS ours, round(b, 6) AS baseline, round(a - b, 6) AS delta FROM m",
        "chart_frame": "SELECT pair_id, CASE WHEN length(user_input) > 20 THEN substr(user_input, 1, 20) || '…' ELSE user_input END AS label FROM eval_scores",
        "lexical_overlap": f"WITH d AS (SELECT pair_id, answer, ground_truth, list_distinct(regexp_extract_all(answer, {q(TOKEN)})) AS a, list_distinct(regexp_extract_all(ground_truth, {q(TOKEN)})) AS t FROM qa_comparison) SELECT pair_id, CASE WHEN answer IS NOT NULL AND ground_truth IS NOT NULL THEN round(0.4::DOUBLE * CASE WHEN len(a) + len(t) > 0 THEN {jac} ELSE 0 END + 0.4::DOUBLE * CASE WHEN len(t) > 0 THEN len(list_intersect(a, t))::DOUBLE / len(t) ELSE 0 END + 0.2::DOUBLE * CASE WHEN greatest(length(answer), length(ground_truth)) > 0 THEN least(length(answer), length(ground_truth))::DOUBLE / greatest(length(answer), length(ground_truth)) ELSE 0 END, 6) END AS score FROM d",
        "knn_topk": knn(SIMS, k),
        "knn_per_label": f"SELECT query_id, label, vec_id, similarity, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id)::INT AS rank FROM {SIMS} QUALIFY rank <= 3",
        "knn_prefilter": knn(f"(SELECT * FROM {SIMS} WHERE label < 5)", k),
        "knn_postfilter": knn(f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM {SIMS} QUALIFY r <= {k * config.OVERFETCH_VECTOR}) WHERE label < 5)", k),
        "context_precision": f"WITH n AS ({knn(SIMS, k)}), j AS (SELECT query_id, rank, (a.label = b.label)::INT::DOUBLE AS v FROM n JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = query_id), p AS (SELECT query_id, v, sum(v) OVER (PARTITION BY query_id ORDER BY rank) / rank * v AS p FROM j) SELECT query_id, round(sum(p) / (sum(v) + 1e-10), 6) AS context_precision FROM p GROUP BY 1",
        "bm25_term_stats": f"WITH {BM25} SELECT grp, term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk": f"WITH {scored(False)} SELECT query_id, grp AS book_name, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id, grp)::INT AS rank FROM al QUALIFY rank <= {k}",
        "bm25_topk_per_book": f"WITH {scored(True)} SELECT query_id, grp AS book_name, row_id, score, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, row_id)::INT AS rank FROM al QUALIFY rank <= {k}",
        "hybrid_fusion": fused(every=True) + FUSION,
        "hybrid_dedupe": fused(dedupe=True, every=True) + FUSION,
        "hybrid_prefilter": fused(prefilter=True, every=True) + FUSION,
        "hybrid_cross_book": crossed(k, True) + " SELECT query_id, book_name, row_id, method, round(final_score, 6) AS final_score, r AS rank FROM cb",
        "hybrid_instruction": fused(query=f"{q(config.INSTRUCTION)} || query", every=True) + FUSION,
        "hybrid_hyde": fused(query="'教材中对此的说明如下：' || query || '。'", every=True) + FUSION,
        "hybrid_rerank": fused(times=config.OVERFETCH_RERANK) + f", t2 AS (SELECT fu.*, list_distinct(regexp_extract_all(query, {q(TOKEN)})) AS qw, regexp_extract_all(content, {q(TOKEN)}) AS tw FROM fu JOIN (SELECT query_id, query FROM asked) USING (query_id) JOIN (SELECT row_id, content FROM chunks) USING (row_id)), s2 AS (SELECT *, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, tw))::DOUBLE / len(qw) ELSE 0 END, 9) AS s FROM t2) SELECT query_id, book_name, row_id, method, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id, book_name ORDER BY s DESC, place)::INT AS rank FROM s2 QUALIFY rank <= {k}",
        "ask": answers(True) + " SELECT query_id, hits, md5(context) AS context_md5, md5(prompt) AS prompt_md5, answer, model, CASE WHEN found THEN (length(prompt) + least(length(context), 200))::INT END AS tokens, sources, success FROM an",
        "answers_kept": answers() + " SELECT query_id, answer FROM an WHERE success",
        "answers_aside": answers(True) + " SELECT query_id FROM an WHERE NOT success",
        "eval_dataset": crossed(config.EVAL_TOP_K, True) + ", x AS (SELECT cb.query_id, string_agg('[' || cb.book_name || ' - ' || coalesce(chapter, '') || ' - ' || coalesce(chunks.section_h2, '') || ']' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY r) AS t, count(*)::INT AS n FROM cb JOIN chunks USING (row_id) GROUP BY 1), g AS (SELECT question_id AS query_id, min(ground_truth) AS ground_truth FROM eval_questions GROUP BY 1) SELECT query_id, query, book_name, ground_truth, coalesce(n, 0) AS contexts, md5(coalesce(t, '')) AS contexts_md5 FROM asked LEFT JOIN x USING (query_id) LEFT JOIN g USING (query_id)",
        "eval_baseline": f"WITH {asked('1')}, g AS (SELECT question_id AS query_id, min(ground_truth) AS ground_truth FROM eval_questions GROUP BY 1) SELECT query_id, query, ground_truth, 1 AS contexts, '' AS text FROM asked LEFT JOIN g USING (query_id)",
        "faithfulness": share("faithfulness", "answer", "ground_truth"),
        "context_recall": share("context_recall", "ground_truth", "answer"),
        "answer_relevancy": f"WITH p AS (SELECT * FROM qa_comparison WHERE question IS NOT NULL AND answer IS NOT NULL), a AS {BAG.format(id='pair_id', text='question', table='p')}, b AS {BAG.format(id='pair_id', text='answer', table='p')}, d AS (SELECT pair_id, sum(a.n * b.n) AS d FROM a JOIN b USING (pair_id, b) GROUP BY 1), la AS (SELECT pair_id, sum(n * n) AS l FROM a GROUP BY 1), lb AS (SELECT pair_id, sum(n * n) AS l FROM b GROUP BY 1) SELECT pair_id, round(coalesce(d / sqrt(la.l * lb.l), 0.0::DOUBLE), 6) AS answer_relevancy FROM p LEFT JOIN d USING (pair_id) LEFT JOIN la USING (pair_id) LEFT JOIN lb USING (pair_id)",
        "top_sources": crossed(k, True) + " SELECT query_id, r AS place, book_name, row_id FROM cb WHERE r <= 3",
        "result_display": "SELECT row_id AS query_id, 1 AS place, '0.5000' AS similarity, 'embedding' AS method, book_name, coalesce(chapter, '') || ' | ' || coalesce(section_h2, '') AS section, CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE coalesce(content, '') END AS preview, concat_ws(' | ', CASE WHEN has_code THEN '💻 含代码' END, CASE WHEN has_image THEN '🖼️ 含图片' END) AS flags FROM chunks WHERE book_name IS NOT NULL",
        "point_lookup": "SELECT row_id, book_name, chunk_id, md5(content) AS content_md5 FROM chunks WHERE row_id IN (SELECT question_id FROM eval_questions WHERE question_id % 20 = 0 AND question IS NOT NULL)",
        "chunk_preview": "SELECT repeat('=', 80) || chr(10) || 'Chunk: ' || coalesce(chunk_id, '') || chr(10) || concat_ws(' > ', nullif(chapter, ''), nullif(section_h2, ''), nullif(section_h3, ''), nullif(section_h4, '')) || chr(10) || repeat('-', 80) || chr(10) || substr(coalesce(content, ''), 1, 500) || CASE WHEN length(content) > 500 THEN chr(10) || '... (内容已截断)' ELSE '' END AS text FROM chunks",
        "messages": "SELECT pair_id, to_json([{'role': 'user', 'content': coalesce(question, '')}, {'role': 'assistant', 'content': coalesce(answer, '')}])::VARCHAR AS messages FROM qa_comparison",
        "context_pack": f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY row_id) AS place FROM chunks WHERE stem IS NOT NULL), b AS (SELECT stem, place, {blocks("'0.500'", "'embedding'")} AS block FROM o), r AS (SELECT *, sum(length(block)) OVER (PARTITION BY stem ORDER BY place) <= {config.CONTEXT_CHARS} AS fits FROM b), c AS (SELECT stem, coalesce(string_agg(block, '' ORDER BY place) FILTER (fits), '') || CASE WHEN bool_and(fits) THEN '' ELSE {q(hybrid.CUT)} END AS context, count(*) FILTER (fits) AS used FROM r GROUP BY stem) SELECT stem, md5(context) AS context_md5, length(context)::INT AS chars, used::INT AS used FROM c",
        "prompt_build": "SELECT pair_id, md5(" + prompted("coalesce(question, '')", "coalesce(ground_truth, '')") + ") AS prompt_md5 FROM qa_comparison",
        "collection_counts": "SELECT book_name, count(*) AS chunks FROM chunks WHERE book_name IS NOT NULL GROUP BY 1",
        "load_throughput": "WITH s AS (SELECT book_name, count(*) AS chunks, (epoch_us(max(loaded_at)) - epoch_us(min(loaded_at)))::DOUBLE / 1e6 AS seconds FROM chunks WHERE book_name IS NOT NULL GROUP BY 1) SELECT book_name, chunks, round(seconds, 6) AS seconds, round(seconds / chunks, 6) AS seconds_per_row, round(chunks / nullif(seconds, 0), 6) AS rows_per_second FROM s",
        "collection_sample": "SELECT book_name, row_id, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '...' ELSE content END AS preview FROM chunks WHERE book_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_name ORDER BY row_id) = 1",
        "catalog_list": "SELECT name, replace(name, 'textbook_', '') AS book_name FROM collections WHERE name LIKE 'textbook_%'",
        "catalog_with_all": "SELECT book_name FROM collections UNION ALL SELECT '全部教材'",
        "book_exists": "SELECT question_id, book_name FROM eval_questions WHERE book_name IN (SELECT book_name FROM collections)",
        "book_missing": "SELECT question_id, question FROM eval_questions e WHERE NOT EXISTS (SELECT 1 FROM collections c WHERE c.book_name = e.book_name)",
        "label_lookup": "SELECT question_id, e.book_name, coalesce(label, array_to_string(list_transform(string_split(replace(e.book_name, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')) AS label FROM eval_questions e LEFT JOIN collections c ON c.book_name = e.book_name",
        "section_path": "SELECT row_id, coalesce(nullif(concat_ws(' > ', " + ", ".join(f"nullif({strip(c)}, '')" for c in ("chapter", "section_h2", "section_h3")) + "), ''), '未标注章节') AS path FROM chunks",
        "snippet": "SELECT row_id, " + replaced("(substr(content, 1, 220) || CASE WHEN length(content) > 220 THEN '...' ELSE '' END)", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))) + " AS snippet FROM chunks",
        "stems": "SELECT row_id, replace(stem, '_cleaned', '_chunks') AS name, regexp_replace(replace(stem, '_cleaned', '_chunks'), '_chunks$', '') AS stem, regexp_replace(regexp_replace(stem, '[^a-zA-Z0-9._-]', '_', 'g'), '^_+|_+$', '', 'g') AS collection FROM chunks",
        "selection": "WITH s AS (SELECT question_id, question_id % 12 AS one, question_id % 5 + 1 AS low, question_id % 9 + 1 AS high FROM eval_questions) SELECT question_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([one - 1], CASE WHEN low <= high THEN range(low - 1, high) ELSE [] END), lambda i: i >= 0 AND i < 10))), ',') AS chosen FROM s",
        "page_segments": "WITH p AS (SELECT row_id, (row_id % 450 + 1)::INT AS pages FROM chunks), s AS (SELECT row_id, pages, unnest(range(0, greatest(ceil(pages / 100.0)::INT, 1)))::INT AS segment FROM p) SELECT row_id, segment, segment * 100 + 1 AS first, least((segment + 1) * 100, pages) AS last FROM s",
        "latest_load": "SELECT stem, chunk_id, max(row_id) AS row_id FROM chunks WHERE stem IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2",
    }
    return out
