"""SQL counterparts of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

from .functions.languages import CODE_EXTENSIONS, FILE_TYPES, NAMED_FILES
from .operators.evaluation import STOP_WORDS
from .operators.fusion import QUESTION_PATTERNS, STRATEGIES

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
LEX = "[a-z_][a-z0-9_]*"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"

_NOW = """now_files as (
    select * from files qualify row_number() over (partition by repo_name, repo_path order by crawled_at desc nulls last) = 1)"""
_CHUNKS = "one_chunks as (select distinct on (seq) * from chunks order by seq)"
_PAIRS = """pairs as (
    select * from qa_pairs qualify row_number() over (partition by id order by mined_at desc nulls last, loaded_at desc nulls last, answer_score desc nulls last) = 1)"""


def _lines(column: str) -> str:
    parts = f"regexp_split_to_array({column}, '{LINE_END}')"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def _case(pairs: dict[str, str], column: str) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then '{v}'" for k, v in pairs.items()) + " end"


_NAME = "regexp_extract(repo_path, '[^/]*$')"
_TYPE = f"coalesce({_case(NAMED_FILES, _NAME)}, case when {_NAME} like 'Dockerfile%' then 'dockerfile' end, {_case(FILE_TYPES, f"lower(regexp_extract({_NAME}, '[^/](\\.[^./]+)$', 1))")}, 'unknown')"


def _language(path: str) -> str:
    return _case(CODE_EXTENSIONS, f"lower(regexp_extract({path}, '(\\.[A-Za-z]+)$', 1))")


def _score(kind: str, column: str) -> str:
    return " + ".join(f"regexp_matches(lower({column}), '{p}')::int" for p in QUESTION_PATTERNS[kind])


def _predicted(column: str) -> str:
    a, b, c = (f"({_score(k, column)})" for k in QUESTION_PATTERNS)
    return f"case when greatest({a}, {b}, {c}) = 0 then 'logic' when {a} >= greatest({b}, {c}) then 'architecture' when {b} >= {c} then 'logic' else 'deployment' end"


_BM25 = f"""
    q as (select item_id question_id, text question from eval_items where item_id % 50 = 0),
    toks as (select doc_id, unnest(regexp_extract_all(lower(text), '{LEX}')) term from documents where text is not null),
    dls as (select doc_id, coalesce(len(regexp_extract_all(lower(text), '{LEX}')), 0) dl from documents),
    avgs as (select avg(dl) avgdl, count(*) n_docs from dls),
    dfs as (select term, count(distinct doc_id) df from toks group by 1),
    raws as (select term, df, n_docs, ln(n_docs - df + 0.5) - ln(df + 0.5) raw_idf from dfs, avgs),
    idfs as (select term, df, n_docs, case when raw_idf < 0 then 0.25 * (select avg(raw_idf) from raws) else raw_idf end idf from raws),
    qt as (select question_id, term, count(*) qtf from (select question_id, unnest(regexp_extract_all(lower(question), '{LEX}')) term from q) group by 1, 2),
    tfs as (select doc_id, term, count(*) tf from toks where term in (select term from qt) group by 1, 2),
    scores as (
        select question_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
        from tfs join qt using (term) join idfs using (term) join dls using (doc_id), avgs group by 1, 2),
    lexical as (
        select question_id, doc_id, score, row_number() over (partition by question_id order by round(score, 9) desc, doc_id) rank from scores where score > 0)"""
_SEMANTIC = f"""
    vec_of as (
        select 'd' side, doc_id id, term, count(*) tf from toks group by 1, 2, 3
        union all select 'q', question_id, term, qtf from qt),
    slots as (select side, id, ('0x' || substr(md5(term), 1, 2))::int % 64 slot, sum(tf)::double v from vec_of group by 1, 2, 3),
    cells as (select side, id, slot, (v / sqrt(sum(v * v) over (partition by side, id)))::float::double x from slots),
    norms as (select side, id, sqrt(sum(x * x)) norm from cells group by 1, 2),
    near as (
        select q.id question_id, d.id doc_id, 1 - sum(q.x * d.x) / (any_value(nq.norm) * any_value(nd.norm)) score
        from cells q join cells d on q.side = 'q' and d.side = 'd' and q.slot = d.slot
        join norms nq on nq.side = 'q' and nq.id = q.id join norms nd on nd.side = 'd' and nd.id = d.id group by 1, 2),
    semantic as (select question_id, doc_id, score, row_number() over (partition by question_id order by round(score, 9), doc_id) rank from near),
    typed as (select question_id, {_predicted('question')} t from q),
    strategies as (select * from (values {", ".join(f"('{t}', {sk}, {bk}, {sw}, {bw})" for t, sk, bk, _, sw, bw in STRATEGIES)}) s(t, sk, bk, sw, bw)),
    ranked as (
        select question_id, 1 list_no, rank, doc_id, sw weight from semantic join typed using (question_id) join strategies using (t) where rank <= sk
        union all select question_id, 2, rank, doc_id, bw from lexical join typed using (question_id) join strategies using (t) where rank <= bk),
    fused as (select question_id, doc_id, sum(weight / (60 + rank)) score, min(list_no * 1000 + rank) seen from ranked group by 1, 2),
    final as (select question_id, doc_id, score, row_number() over (partition by question_id order by round(score, 12) desc, seen, doc_id) rank from fused)"""

_FOLDED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(folder || '/' || raw, '/./', '/'), '[^/.]+/\\.\\./', ''), '[^/.]+/\\.\\./', ''), '[^/.]+/\\.\\./', ''), '^(\\.\\./)+', ''), '^(\\./)+(\\.\\./)*', '')"
_EDGES = rf"""
    targets as (
        select distinct repo_name, src, ord, coalesce(nullif(case
            when lang = 'python' then coalesce(nullif(regexp_extract(raw, '^from[ \t]+(\.*[\w.]*)[ \t]+import\b', 1), ''), nullif(regexp_extract(raw, '^import[ \t]+([\w.]+)[ \t]*(?:,|;|#|$)', 1), ''))
            when lang in ('javascript', 'typescript') then coalesce(nullif(regexp_extract(raw, '^import\b[^''"]*[''"]([^''"]+)[''"]', 1), ''), regexp_extract(raw, 'require\([''"]([^''"]+)[''"]\)', 1))
            when lang = 'java' then regexp_extract(raw, '^import[ \t]+(?:static[ \t]+)?([\w.]+?)(?:\.\*)?[ \t]*;', 1)
            when lang in ('c', 'cpp') then regexp_extract(raw, '^#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', 1)
            when lang = 'rust' then regexp_extract(raw, '^use[ \t]+([^;]+);', 1)
            when lang = 'go' then regexp_extract(raw, '^(?:import[ \t]+)?[ \t]*(?:[\w.]+[ \t]+)?"([^"]+)"', 1) end, ''), null) raw, lang,
            coalesce(nullif(regexp_extract(src, '^(.*)/[^/]+$', 1), ''), '.') folder
        from (select *, {_language('src')} lang from raw_imports)),
    stepped as (
        select *, len(regexp_extract(raw, '^(\.*)', 1)) dots, replace(regexp_replace(raw, '^\.+', ''), '.', '/') module, replace(raw, '.', '/') slashed,
            case when len(regexp_extract(raw, '^(\.*)', 1)) <= 1 then folder else
                coalesce(nullif(regexp_extract(folder, '^(.*)(?:/[^/]+)' || '{{' || (len(regexp_extract(raw, '^(\.*)', 1)) - 1) || '}}$', 1), ''), '.') end base,
            {_FOLDED} folded
        from targets where raw is not null),
    wanted as (
        select repo_name, src, ord, case
            when lang = 'python' and raw like '.%' and module = '' then [base || '/__init__.py']
            when lang = 'python' and raw like '.%' then [base || '/' || module || '.py', base || '/' || module || '/__init__.py']
            when lang = 'python' then [slashed || '.py', slashed || '/__init__.py', 'src/' || slashed || '.py', 'src/' || slashed || '/__init__.py']
            when lang in ('javascript', 'typescript') and raw like '.%' then [folded || '.js', folded || '.ts', folded || '.tsx', folded || '.jsx', folded || '/index.js', folded || '/index.ts', folded]
            when lang = 'java' then [slashed || '.java', 'src/main/java/' || slashed || '.java']
            when lang in ('c', 'cpp') then [folder || '/' || raw, raw, 'src/' || raw, 'include/' || raw]
            when lang = 'go' and contains(raw, '/') then [raw || '.go'] else [] end list
        from stepped),
    posed as (select repo_name, src, ord, unnest(list) dst, unnest(range(len(list))) pos from wanted),
    cleaned as (select repo_name, src, ord, regexp_replace(dst, '^(\./)+', '') dst, pos from posed),
    edges as (select c.repo_name, src, ord, arg_min(dst, pos) dst from cleaned c join (select distinct repo_name, repo_path from files) f on f.repo_name = c.repo_name and f.repo_path = c.dst group by 1, 2, 3)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = r"[\p{L}\p{N}\p{M}_]+"
_KEYWORDS = rf"""list_sort(list_distinct(list_concat(
    list_filter(list_transform(regexp_extract_all(answer, '`([^`]+)`', 1), lambda x: lower(trim(x, '@().,:;'))), lambda x: length(x) >= 2),
    list_filter(regexp_extract_all(answer, '{_WORDS}'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]{{2,}}') and x not in ({_STOP})),
    list_transform(list_filter(regexp_extract_all(answer, '{_WORDS}'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]{{3,}}')), lambda x: lower(x)))))"""

_SHORT_STRINGS = r"""("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')"""
ORACLE_SQL: dict[str, str] = {
    "file_types": f"with {_NOW} select repo_name, {_TYPE} file_type, count(*) n_files, sum(coalesce(length(raw_content), 0)) n_chars from now_files group by 1, 2",
    "file_state": f"with {_NOW} select repo_name, repo_path, length(raw_content) n_chars, left(crawled_at::varchar, 19) crawled_at from now_files",
    "doc_tokens": f"select doc_id, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) n_tokens, coalesce(len(regexp_extract_all(lower(text), '{LEX}')), 0) n_lexical from documents",
    "term_stats": f"with {_BM25.split('qt as')[0].rstrip().rstrip(',')} select term, df, n_docs, round(idf, 6) idf from idfs",
    "bm25_topk": f"with {_BM25} select question_id, rank, doc_id, round(score, 6) score from lexical where rank <= 10",
    "knn_topk": """
        select * from (select question_id, doc_id, round(score, 6) score, row_number() over (partition by question_id order by round(score, 9), doc_id) rank from (
            select q.vec_id question_id, d.vec_id doc_id, 1 - list_cosine_similarity(q.embedding::double[], d.embedding::double[]) score
            from embeddings q, embeddings d where q.vec_id % 50 = 0)) where rank <= 10""",
    "knn_filtered": """
        select * from (select question_id, doc_id, round(score, 6) score, row_number() over (partition by question_id order by round(score, 9), doc_id) rank from (
            select q.vec_id question_id, d.vec_id doc_id, 1 - list_cosine_similarity(q.embedding::double[], d.embedding::double[]) score
            from embeddings q, embeddings d where q.vec_id % 50 = 0 and d.label = 3)) where rank <= 10""",
    "hybrid_topk": f"with {_BM25}, {_SEMANTIC} select question_id, rank, doc_id, round(score, 9) score from final where rank <= 10",
    "question_types": f"with {_PAIRS} select coalesce(nullif(question_type, ''), 'none') question_type, {_predicted('question')} predicted_type, count(*) n from pairs group by 1, 2",
    "import_edges": f"with {_EDGES} select repo_name, src, ord, dst from edges",
    "import_degrees": f"""with {_EDGES},
        o as (select repo_name, src path, count(distinct dst) n_imports from edges group by 1, 2), b as (select repo_name, dst path, count(distinct src) n_importers from edges group by 1, 2)
        select repo_name, path, coalesce(n_imports, 0) n_imports, coalesce(n_importers, 0) n_importers from o full join b using (repo_name, path)""",
    "import_neighbors": f"""with {_EDGES} select distinct repo_name, path, neighbor from (
        select repo_name, src path, dst neighbor from edges union all select repo_name, dst, src from edges) where path <> neighbor""",
    "graph_summary": f"""with {_EDGES}, n as (select repo_name, count(distinct p) n_nodes from (select repo_name, src p from edges union all select repo_name, dst from edges) group by 1)
        select repo_name, count(distinct src) n_sources, count(*) n_edges, any_value(n_nodes) n_nodes, count(*) / greatest(count(distinct src), 1) avg_edges from edges join n using (repo_name) group by 1""",
    "markdown_sections": f"""with {_NOW},
        l as (select repo_name, repo_path, unnest({_lines('raw_content')}) line, unnest(range(len({_lines('raw_content')}))) i from now_files where raw_content is not null and lower(repo_path) like '%.md'),
        s as (select *, sum((regexp_matches(line, '^#{{1,6}}\\s') and i > 0)::int) over (partition by repo_name, repo_path order by i) section from l)
        select repo_name, repo_path, section::bigint section, (min(i) + 1)::int start_line, (max(i) + 1)::int end_line, sum(len(regexp_extract_all(line, '{TOKEN}')))::bigint n_tokens from s group by 1, 2, 3""",
    "uncovered_lines": f"""with {_NOW},
        l as (select repo_name, repo_path, unnest(range(1, len({_lines('raw_content')}) + 1)) line from now_files where raw_content is not null and len({_lines('raw_content')}) > 0),
        c as (select distinct repo_name, repo_path, unnest(range(start_line, end_line + 1)) line from chunks where start_line is not null and end_line >= start_line),
        f as (select * from l anti join c using (repo_name, repo_path, line)),
        g as (select *, line - row_number() over (partition by repo_name, repo_path order by line) g from f)
        select repo_name, repo_path, min(line)::int start_line, max(line)::int end_line from g group by repo_name, repo_path, g""",
    "chunk_stats": f"""with {_CHUNKS} select grouping(chunk_type, coalesce(nullif(language, ''), 'none'))::bigint grouping, chunk_type, coalesce(nullif(language, ''), 'none') as language, count(*) n_chunks,
        sum(len(regexp_extract_all(content, '{TOKEN}')))::bigint n_tokens from one_chunks group by grouping sets ((chunk_type), (coalesce(nullif(language, ''), 'none')), ())""",
    "chunk_ids": f"with {_CHUNKS} select repo_name, count(*) n_chunks, count_if(substr(sha256(repo_path || ':' || start_line), 1, 16) = id) n_equal, count(distinct id) n_ids from one_chunks group by 1",
    "first_last_by_id": "select id, min(seq) first_seq, max(seq) last_seq from chunks group by 1 having min(seq) <> max(seq)",
    "pack_prefix": f"""with {_CHUNKS}, n as (select repo_name, repo_path, seq, len(regexp_extract_all(content, '{TOKEN}')) n from one_chunks where content is not null),
        r as (select *, sum(n) over w used, row_number() over w k from n window w as (partition by repo_name, repo_path order by seq))
        select repo_name, repo_path, count(*) n_chunks, max(used)::bigint used from r where used <= 800 or k = 1 group by 1, 2""",
    "pack_skip": f"""with recursive {_CHUNKS},
        n as (select repo_name, repo_path, seq, len(regexp_extract_all(content, '{TOKEN}'))::bigint n, row_number() over (partition by repo_name, repo_path order by seq) k from one_chunks where content is not null),
        f as (select repo_name, repo_path, k, case when n <= 600 then n else 0 end::bigint used, (n <= 600)::int taken from n where k = 1
            union all select n.repo_name, n.repo_path, n.k, case when f.used + n.n <= 600 then f.used + n.n else f.used end, f.taken + (f.used + n.n <= 600)::int
            from f join n on n.repo_name = f.repo_name and n.repo_path = f.repo_path and n.k = f.k + 1)
        select repo_name, repo_path, max(taken)::int n_chunks, max(used) used from f group by 1, 2""",
    "citation_coverage": rf"""with {_PAIRS},
        t as (select id, repo_name, list_transform(reference_contexts, lambda x: '[' || x || ']') refs from pairs where len(reference_contexts) > 0),
        u as (select id, repo_name, unnest(refs) raw, unnest(range(len(refs))) k from t),
        c as (select id, repo_name, raw, k, regexp_extract(raw, '\[([^\[\]\s]+?)(?::(\d+)(?:-(\d+))?)?\]', 1) file_path, nullif(regexp_extract(raw, '\[([^\[\]\s]+?)(?::(\d+)(?:-(\d+))?)?\]', 2), '')::int a,
            nullif(regexp_extract(raw, '\[([^\[\]\s]+?)(?::(\d+)(?:-(\d+))?)?\]', 3), '')::int z from u),
        v as (select c.id, c.k, min(case when a is null or not (coalesce(z, a) < h.start_line or a > h.end_line) then h.seq end) seq
            from c left join (select distinct repo_name, repo_path, start_line, end_line, seq from chunks) h on h.repo_name = c.repo_name and h.repo_path = c.file_path group by 1, 2)
        select id answer_id, count(*) n_citations, count(seq) n_verified, count(distinct seq) n_chunks, count(seq) / greatest(count(*), 1) coverage,
            count(seq) < count(*) and count(seq) / greatest(count(*), 1) < 0.5 low_coverage from v group by 1""",
    "gold_hits": f"""with {_PAIRS}, {_NOW},
        g as (select id, repo_name, regexp_replace(unnest(reference_contexts), ':.*$', '') path from pairs where len(reference_contexts) > 0)
        select id, path, count(f.repo_path) > 0 hit from g left join now_files f on f.repo_name = g.repo_name and (f.repo_path = path or f.repo_path like '%/' || path or path like '%/' || f.repo_path) group by 1, 2""",
    "keywords": f"with {_PAIRS} select id, {_KEYWORDS} keywords from pairs where answer is not null",
    "keyword_recall": f"""with {_PAIRS}, k as (select repo_name, question, {_KEYWORDS} kw from pairs where answer is not null)
        select repo_name, count(*) n, round(avg(case when len(kw) > 0 then len(list_filter(kw, lambda x: contains(lower(coalesce(question, '')), x))) / len(kw) else 0 end), 9) mean_recall from k group by 1""",
    "extracted_imports": rf"""with f as (select repo_name, repo_path, lower(regexp_extract(repo_path, '\.([A-Za-z]+)$', 1)) ext,
            regexp_replace(arg_max({{'c': raw_content}}, coalesce(crawled_at, timestamp '0001-01-01'))['c'], '\r\n?', chr(10), 'g') t from files group by 1, 2),
        n as (select *, case when ext = 'py' then regexp_replace(regexp_replace(t, '"{{3}}(?s:.)*?"{{3}}|''{{3}}(?s:.)*?''{{3}}|#[^\n]*|{_SHORT_STRINGS}', '\1', 'g'), '\\\n', ' ', 'g')
            when ext in ('js', 'ts') then regexp_replace(t, '/\*(?s:.)*?\*/|//[^\n]*|`(?:[^`\\]|\\(?s:.))*`|{_SHORT_STRINGS}', '\1', 'g')
            when ext = 'go' then regexp_replace(t, '/\*(?s:.)*?\*/|//[^\n]*|`[^`]*`|{_SHORT_STRINGS}', '\1', 'g') when ext = 'rs' then regexp_replace(t, '/\*(?s:.)*?\*/|//[^\n]*|("(?:[^"\\]|\\(?s:.))*")', '\1', 'g')
            else regexp_replace(t, '/\*(?s:.)*?\*/|//[^\n]*|{_SHORT_STRINGS}', '\1', 'g') end code from f where t is not null and ext in ('py', 'js', 'ts', 'java', 'go', 'rs', 'c', 'cpp', 'cc')),
        r as (select repo_name, repo_path, case
            when ext = 'py' then list_transform(regexp_extract_all(code, '(?m)^(?:from[ \t]+\.*[\w.]*[ \t]+import\b|import[ \t]+[\w.]+[ \t]*(?:,|;|#|$))'), lambda x: regexp_extract(x, '^(?:from|import)[ \t]+([\w.]+)', 1))
            when ext in ('js', 'ts') then regexp_extract_all(code, '(?m)^import\b[^''";()]*[''"]([^''"]+)[''"]', 1)
            when ext = 'java' then regexp_extract_all(code, '(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+?)(?:\.\*)?[ \t]*;', 1)
            when ext = 'rs' then list_transform(regexp_extract_all(code, '(?m)^use[ \t]+([^;]+);', 1), lambda x: regexp_replace(x, '\s+', ' ', 'g'))
            when ext = 'go' then flatten(list_transform(regexp_extract_all(code, '(?m)^import[ \t]*(?:\([^)]*\)|(?:[\w.]+[ \t]+)?"[^"\n]+")'), lambda x: regexp_extract_all(x, '"([^"\n]+)"', 1)))
            else regexp_extract_all(code, '(?m)^#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', 1) end raws from n)
        select repo_name, repo_path src, unnest(range(len(raws)))::int ord, unnest(raws) raw from r""",
    "grounding_totals": rf"""with {_PAIRS}, t as (select id, coalesce(nullif(question_type, ''), 'none') as level, question, answer from pairs where answer is not null),
        q as (select id, trim(regexp_replace(x, '^\s+|\s+$', '', 'g'), '()@,.:;* ') x from (select id, unnest(regexp_extract_all(answer, '`([^`]+)`', 1)) x from t)
            union select id, regexp_extract(x, '^[A-Za-z_][A-Za-z0-9_]*') from (select id, unnest(regexp_extract_all(answer, '\b[A-Za-z_][A-Za-z0-9_]+\(\)')) x from t)),
        k as (select distinct id, x from q where length(x) >= 3 and position(' ' in x) = 0 and lower(x) not in ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'into', 'file', 'path', 'name', 'code', 'data', 'list', 'dict', 'true', 'false', 'none', 'null')),
        i as (select level, question, coalesce((select list(x) from k where k.id = t.id), []) ids from t),
        m as (select level, len(ids) n, len(list_filter(ids, lambda x: not contains(question, x) and not contains(question, replace(x, '()', '')))) miss from i)
        select level, count(*) n, sum(n)::bigint n_identifiers, sum(miss)::bigint n_missing, count_if(miss > 0) n_with_missing, round(case when sum(n) > 0 then 1 - sum(miss) / sum(n) else 1 end, 9) grounded from m group by 1""",
    "config_stats": "select event_type, count(*) n, round(avg(value), 6) value_mean, round(coalesce(stddev_samp(value), 0), 6) value_std from events group by 1",
    "config_pivot": f"""select user_id, {", ".join(f"round(coalesce(avg(value) filter (event_type = '{e}'), 0), 6) {e}_mean, round(coalesce(stddev_samp(value) filter (event_type = '{e}'), 0), 6) {e}_std" for e in ("click", "error", "purchase", "signup", "view"))} from events group by 1""",
    "config_deltas": """with m as (select event_type, avg(value) v from events group by 1) select event_type, round((select v from m where event_type = 'view') - v, 6) delta from m""",
    "event_windows": "select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n, round(avg(value), 6) mean_value from events group by 1, 2",
    "json_keys": "select key, count(*) n from (select unnest(json_keys(props)) as key from events) group by 1",
    "dataset_summary": """select grouping(coalesce(language, 'none'), coalesce(nullif(question_type, ''), 'none'))::bigint grouping, coalesce(language, 'none') as language, coalesce(nullif(question_type, ''), 'none') as question_type,
        count(distinct id) n_pairs, count(distinct repo_name) n_repos from qa_pairs group by grouping sets ((coalesce(language, 'none')), (coalesce(nullif(question_type, ''), 'none')), ())""",
    "curated_pairs": f"with {_PAIRS} select id, repo_name, answer_score from pairs where answer_score >= 5 and length(question) >= 80 and not contains(substr(question, 1, 30), 'https://')",
    "paths_difference": """select repo_name, repo_path, 'left' side from ((select distinct repo_name, repo_path from files) except (select distinct repo_name, repo_path from chunks))
        union all select repo_name, repo_path, 'right' from ((select distinct repo_name, repo_path from chunks) except (select distinct repo_name, repo_path from files))""",
    "folder_rollup": f"""with {_CHUNKS}, t as (select repo_name, repo_path, sum(len(regexp_extract_all(content, '{TOKEN}'))) n from one_chunks group by 1, 2),
        a as (select repo_name, n, unnest(list_transform(range(len(string_split(repo_path, '/'))), lambda i: case when i = 0 then '.' else array_to_string(string_split(repo_path, '/')[1:i], '/') end)) folder from t)
        select repo_name, folder, count(*) n_files, sum(n)::bigint n_tokens from a group by 1, 2""",
    "largest_chunks": f"""with {_CHUNKS} select chunk_type, seq, n, rank from (select chunk_type, seq, len(regexp_extract_all(content, '{TOKEN}')) n,
        row_number() over (partition by chunk_type order by len(regexp_extract_all(content, '{TOKEN}')) desc, seq) rank from one_chunks where content is not null) where rank <= 5""",
    "index_rows": f"""with {_CHUNKS} select repo_name, id, seq, 'chunk' doc_type, coalesce(chunk_type, '') chunk_type, repo_path file_path, coalesce(language, '') as language, coalesce(start_line, -1) start_line,
        coalesce(end_line, -1) end_line, coalesce(symbol_name, '') symbol_name, '' summary_level from one_chunks""",
    "gold_coverage": rf"""with {_PAIRS}, {_CHUNKS},
        r as (select id qid, repo_name, unnest(reference_contexts) c from pairs where len(reference_contexts) > 0),
        g as (select qid, repo_name, regexp_extract(c, '^(.*?)(?::(\d+)(?:-(\d+))?)?$', 1) path, nullif(regexp_extract(c, '^(.*?)(?::(\d+)(?:-(\d+))?)?$', 2), '')::int lo, nullif(regexp_extract(c, '^(.*?)(?::(\d+)(?:-(\d+))?)?$', 3), '')::int hi from r)
        select qid, count(distinct path) n_paths, count(distinct case when seq is not null then path end) n_indexed,
            count(distinct case when lo is null or not (end_line < lo or start_line > coalesce(hi, lo)) then seq end) n_chunks
        from g left join (select repo_name, repo_path path, seq, start_line, end_line from one_chunks) h using (repo_name, path) group by 1""",
    "retrieval_modes": f"""with {_BM25}, {_SEMANTIC},
        fused_one as (select question_id, list_no, doc_id, row_number() over (partition by question_id, list_no order by rank, doc_id) rank from ranked),
        hits as (select 'hybrid' as mode, question_id, doc_id from final where rank <= 8
            union all select case list_no when 1 then 'semantic' else 'bm25' end, question_id, doc_id from fused_one where rank <= 8),
        corpora as (select mode, question_id, lower(string_agg(text, chr(10))) corpus from hits join documents using (doc_id) group by 1, 2),
        k as (select question_id, {_KEYWORDS} kw from (select question_id, question answer from q))
        select mode, question_id, round(case when len(kw) > 0 then len(list_filter(kw, lambda x: contains(corpus, x))) / len(kw) else 0 end, 9) recall from corpora join k using (question_id)""",
}
