"""Queries of the chunker over all documents, taken as books: their lines, with headings put in by rule, dealt to pages and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import chunk, structure
from loam.registry import SQL_WORDS, T, doc_texts, query

c = F.col

#: Lines of a page, pages of a chapter. Every third line, if long, gets a heading of its own first words: by turns of level 1 and of level 2.
PAGE_LINES, CHAPTER_PAGES = 5, 3


def book_pages(spark, d):
    """(book, page, chapter, text): a book is a document; every fifth has no chapters."""
    head = "substr(regexp_replace(substr(x, 1, 30), '[^A-Za-z ]', ''), 1, 24)"
    titled = f"case when i % 2 = 0 then concat('SECAO ', upper({head})) else concat('Parte ', lower({head})) end"
    lines = F.expr(f"flatten(transform(split(text, '\\n'), (x, i) -> case when length(x) > 60 and i % 3 = 0 then array({titled}, x) else array(x) end))")
    rows = T(spark, d, "documents").filter("text is not null").select("doc_id", lines.alias("l"))
    pages = F.expr(f"transform(sequence(0, (size(l) - 1) div {PAGE_LINES}), p -> array_join(slice(l, cast(p * {PAGE_LINES} + 1 as int), {PAGE_LINES}), '\\n'))")
    rows = rows.select(c("doc_id").alias("book"), F.posexplode(pages).alias("page", "text"))
    return rows.select("book", "page", F.expr(f"case when book % 5 <> 0 then cast(page div {CHAPTER_PAGES} as int) end").alias("chapter"), "text")


_SPACE = "[ \\t\\n\\r\\f\\v]+"
_HEAD = "substr(regexp_replace(substr(x, 1, 30), '[^A-Za-z ]', '', 'g'), 1, 24)"
PAGES = f"""bl AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN length(x) > 60 AND (i - 1) % 3 = 0
THEN [CASE WHEN (i - 1) % 2 = 0 THEN 'SECAO ' || upper({_HEAD}) ELSE 'Parte ' || lower({_HEAD}) END, x] ELSE [x] END)) AS l FROM documents WHERE text IS NOT NULL),
pages AS (SELECT doc_id AS book, p AS page, CASE WHEN doc_id % 5 <> 0 THEN p // {CHAPTER_PAGES} END AS chapter, array_to_string(l[p * {PAGE_LINES} + 1:p * {PAGE_LINES} + {PAGE_LINES}], chr(10)) AS text
FROM (SELECT doc_id, l, unnest(range(0, (len(l) + {PAGE_LINES - 1}) // {PAGE_LINES})) AS p FROM bl))"""
PARENTS = f"""{PAGES}, pn AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND chapter IS DISTINCT FROM lag(chapter) OVER w THEN 1 ELSE 0 END AS new FROM pages WINDOW w AS (PARTITION BY book ORDER BY page)),
pr AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY page) AS run FROM pn),
ln AS (SELECT book, page, chapter, run, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT *, string_split(text, chr(10)) AS a FROM pr)),
nx AS (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY book, page ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line, regexp_replace(line, '[^\\p{{L}}]', '', 'g') AS letters FROM ln),
hd AS (SELECT *, coalesce(regexp_matches(trim(line), '{structure.HEADING}') AND {SQL_WORDS.format(x='line')} <= 6 AND {SQL_WORDS.format(x='next_line')} > 6, false) AS h FROM nx),
lv AS (SELECT *, CASE WHEN h THEN CASE WHEN letters <> '' AND upper(letters) = letters THEN 1 ELSE 2 END END AS level FROM hd),
il AS (SELECT *, sum(h::INT) OVER w AS island, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS ov, last_value(CASE WHEN level = 1 THEN trim(line) END IGNORE NULLS) OVER w AS top FROM lv WINDOW w AS (PARTITION BY book, run ORDER BY page, pos)),
sb AS (SELECT *, last_value(CASE WHEN level = 2 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY book, run, ov ORDER BY page, pos) AS sub FROM il),
pa AS (SELECT book, run, island, min(chapter) AS chapter, list_filter([min(top), min(sub)], lambda x: x IS NOT NULL) AS path, min(page) AS first_page, max(page) AS last_page, string_agg(line || chr(10), '' ORDER BY page, pos) FILTER (WHERE NOT h) AS text FROM sb GROUP BY book, run, island),
parents AS (SELECT * FROM pa WHERE length(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) > 0)"""
MERGED = f"""{PARENTS}, ms AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR length(regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')) >= 200 OR chapter IS DISTINCT FROM lag(chapter) OVER w THEN 1 ELSE 0 END AS starts FROM parents WINDOW w AS (PARTITION BY book ORDER BY run, island)),
mg AS (SELECT *, sum(starts) OVER (PARTITION BY book ORDER BY run, island) AS g, CASE WHEN starts = 1 THEN text ELSE chr(10) || CASE WHEN len(path) > 0 THEN path[-1] || ' ' ELSE '' END || text END AS t FROM ms),
merged AS (SELECT book, min(run) FILTER (WHERE starts = 1) AS run, min(island) FILTER (WHERE starts = 1) AS island, min(chapter) AS chapter, min(path) FILTER (WHERE starts = 1) AS path, min(first_page) FILTER (WHERE starts = 1) AS first_page, max(last_page) AS last_page, string_agg(t, '' ORDER BY run, island) AS text FROM mg GROUP BY book, g)"""


def windows(source: str, key: str, target: int, overlap: float) -> str:
    """Recursive CTEs that cut ``source`` (key, text): the last, cut, is (key, ordinal, first, words, chunk). Each step finds where its
    window ends in the running sums of the words' lengths."""
    return f"""ww AS (SELECT {key}, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w FROM {source} WHERE text IS NOT NULL),
wu AS (SELECT {key}, list(upto ORDER BY pos) AS u FROM (SELECT {key}, pos, sum(length(x) + 1) OVER (PARTITION BY {key} ORDER BY pos) AS upto FROM (SELECT {key}, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM ww)) GROUP BY {key}),
wl AS (SELECT {key}, w, [0] || u AS u, len(w) AS n FROM ww JOIN wu USING ({key})),
step(k, ordinal, i, j, n) AS (SELECT {key}, -1::BIGINT, 0::BIGINT, 0::BIGINT, n FROM wl UNION ALL
SELECT k, ordinal + 1, nxt, CASE WHEN raw < n THEN coalesce(list_max(list_filter(range(nxt + 1, raw + 1), lambda e: w[e][-1] IN ('.', '!', '?') AND u[e + 1] - u[nxt + 1] - 1 >= floor((u[raw + 1] - u[nxt + 1] - 1) * 0.75::DOUBLE))), raw) ELSE raw END, n
FROM (SELECT k, ordinal, nxt, s.n, w, u, coalesce(list_min(list_filter(range(nxt + 1, s.n + 1), lambda e: u[e + 1] >= u[nxt + 1] + {target})), s.n) AS raw
FROM (SELECT *, CASE WHEN ordinal < 0 THEN 0 ELSE greatest(j - floor((j - i) * {overlap}::DOUBLE)::BIGINT, i + 1) END AS nxt FROM step WHERE ordinal < 0 OR j < n) s JOIN wl ON wl.{key} = s.k)),
cut AS (SELECT k AS {key}, ordinal, i AS first, j - i AS words, array_to_string(w[i + 1:j], ' ') AS chunk FROM step JOIN wl ON wl.{key} = k WHERE ordinal >= 0)"""


@query("build_parents", f"WITH {PARENTS} SELECT book, run::BIGINT AS run, island::BIGINT AS island, chapter, array_to_string(path, ' > ') AS path, len(path) AS depth, first_page, last_page, sha1(text) AS text FROM parents")
def build_parents(spark, d):
    rows = chunk.build_parents(book_pages(spark, d))
    return rows.select("book", "run", "island", "chapter", F.array_join("path", " > ").alias("path"), F.size("path").alias("depth"), "first_page", "last_page", F.sha1("text").alias("text"))


@query("merge_parents", f"WITH {MERGED} SELECT book, run::BIGINT AS run, island::BIGINT AS island, chapter, array_to_string(path, ' > ') AS path, first_page, last_page, sha1(text) AS text FROM merged")
def merge_parents(spark, d):
    rows = chunk.merge_parents(chunk.build_parents(book_pages(spark, d)))
    return rows.select("book", "run", "island", "chapter", F.array_join("path", " > ").alias("path"), "first_page", "last_page", F.sha1("text").alias("text"))


@query("chunk_windows", f"WITH RECURSIVE {windows('documents', 'doc_id', 1638, 0.15)} SELECT doc_id, ordinal, first, words, chunk FROM cut")
def chunk_windows(spark, d):
    return chunk.window_text(doc_texts(spark, d)).withColumnRenamed("id", "doc_id")


@query("chunk", f"""WITH RECURSIVE {MERGED}, flat AS (SELECT row_number() OVER () AS rid, book, chapter, path, first_page, last_page, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS text FROM merged),
named AS (SELECT *, substr(sha1(array_to_string(path, '|') || chr(10) || text), 1, 12) AS id FROM flat), {windows('flat', 'rid', 409, 0.15)}
SELECT id, 'parent' AS level, NULL AS parent_id, 0 AS ordinal, book, chapter, array_to_string(path, ' > ') AS path, first_page, last_page, sha1(text) AS text FROM named
UNION ALL SELECT substr(sha1(array_to_string(path || [ordinal::VARCHAR], '|') || chr(10) || chunk), 1, 12), 'child', id, ordinal, book, chapter, array_to_string(path, ' > '), first_page, last_page, sha1(chunk) FROM cut JOIN named USING (rid)""")
def chunks(spark, d):
    rows = chunk.chunk(book_pages(spark, d), tokens=128)
    return rows.select("id", "level", "parent_id", "ordinal", "book", "chapter", F.array_join("path", " > ").alias("path"), "first_page", "last_page", F.sha1("text").alias("text"))
