"""The same results in SQL that DuckDB runs on the same tables. Shares no code with the library."""

import re

from checks import inputs

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
START, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
NUMBER = rf"(?:rs\.?|inr|₹)?{SPACE}*([0-9][0-9,]*)"
TABLES = ["lineitem", "part", "nation", "region", "documents", "customer"]


def tidy(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'), ' ')"


def word(text: str, words: str) -> str:
    return f"regexp_matches({text}, '{START}(?:{words}){END}')"


def ordered_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def split_tidy(text: str) -> str:
    items = f"list_filter(list_transform(string_split({text}, ','), lambda x: {tidy('x')}), lambda x: x <> '')"
    return f"coalesce({ordered_distinct(items)}, [])"


def reviews_of(lines: str) -> str:
    bare = f"regexp_replace(x, '^{SPACE}*RATED{SPACE}*', '')"
    items = f"list_filter(list_transform(string_split({lines}, chr(10)), lambda x: {tidy(bare)}), lambda x: length(x) >= 30)"
    return f"coalesce({ordered_distinct(items)}, [])"


TOPIC = (
    "(?i)" + START + "(?:family|families|kids|children|veg|vegetarian|budget|cheap|affordable|pocket|ambience|"
    "service|value|group|friends|date|romantic|buffet)" + END
)


def excerpts_of(items: str) -> str:
    ranked = (
        f"list_concat(list_filter({items}, lambda x: regexp_matches(x, '{TOPIC}')), "
        f"list_filter({items}, lambda x: not regexp_matches(x, '{TOPIC}')))[1:6]"
    )
    cut = r"regexp_replace(substr(x, 1, 350), ' [^ ]*$', '') || '...'"
    return f"list_transform({ranked}, lambda x: case when length(x) <= 350 then x else {cut} end)"


def packed(items: str) -> str:
    """Greedy packing: a fold over the quoted items, started with an empty body."""
    pieces = f"list_transform({items}, lambda x: {{'done': []::varchar[], 'body': '- \"' || x || '\"'}})"
    return (
        f"list_reduce({pieces}, lambda a, b: case when length(a.body) + 1 + length(b.body) <= 700 "
        f"then {{'done': a.done, 'body': a.body || chr(10) || b.body}} "
        f"else {{'done': list_append(a.done, a.body), 'body': b.body}} end)"
    )


def packed_list(items: str) -> str:
    return f"case when len({items}) = 0 then [] else list_append({packed(items)}.done, {packed(items)}.body) end"


def price_of(text: str) -> str:
    before = "under|below|less than|within|upto|up to|maximum|max|cheaper than|at most"
    patterns = [
        f"{START}(?:{before}){SPACE}*{NUMBER}",
        f"{START}budget(?: of| is)?{SPACE}*{NUMBER}",
        f"{NUMBER}{SPACE}*(?:or less|and below|max){END}",
    ]

    def amount(pattern):
        value = f"try_cast(nullif(replace(regexp_extract({text}, '{pattern}', 1), ',', ''), '') as bigint)"
        return f"case when {value} >= 50 then {value} end"

    cheap = word(text, "cheap|budget|affordable|inexpensive|pocket[- ]friendly|low[- ]cost")
    return f"coalesce({', '.join(map(amount, patterns))}, case when {cheap} then 500 end)"


def high_rating(text: str) -> str:
    return word(text, "(?:highly|high|top|best|well|good)[- ]?(?:rated|rating|reviewed)|best|top")


def rating_of(text: str) -> str:
    first = (
        rf"{START}(?:rat(?:ed|ing)|stars?){SPACE}*(?:of{SPACE}*)?(?:above|over|at least|more than|>=?|\+)?"
        rf"{SPACE}*([0-9](?:\.[0-9])?)"
    )
    second = rf"{START}([0-9](?:\.[0-9])?){SPACE}*\+?{SPACE}*(?:stars?|rating|rated){END}"
    groups = [f"nullif(regexp_extract({text}, '{first}|{second}', {i}), '')" for i in (1, 2)]
    value = f"cast(coalesce({', '.join(groups)}) as double)"
    return (
        f"coalesce(case when {value} > 0 and {value} <= 5 then {value} end, "
        f"case when {high_rating(text)} then cast(4 as double) end)"
    )


def scalars(text: str) -> str:
    veg = word(text, rf"(?:pure(?:-|{SPACE})*)?veg(?:etarian|gie)?")
    non_veg = f"regexp_matches({text}, '{START}non(?:-|{SPACE})*veg')"
    return f"""
      {price_of(text)} as max_price, {rating_of(text)} as min_rating, {high_rating(text)} as sort_by_rating,
      {veg} and not {non_veg} as pure_veg,
      {word(text, "deliver(?:y|s)?|order online|online order(?:ing)?|home delivery")} as online_order,
      {word(text, "book(?:ing)? a table|table booking|reserv(?:e|ation)|book table")} as book_table"""


def has_phrase(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, '(?:^|[^a-z0-9])' || regexp_escape(lower({phrase})) || '(?:$|[^a-z0-9])')"


def matched_tags(questions: str, vocabulary: str) -> str:
    """Tags named in the question, longest first, without those inside an earlier one."""
    named = f"({has_phrase('lower(q.text)', 'v.value')} or {has_phrase('lower(q.text)', "v.value || 's'")})"
    return f"""
      select question_id, list(value order by place) as tags
      from (select *, row_number() over (partition by question_id order by length(value) desc, value) as place
            from {questions} q join {vocabulary} v on {named}) a
      where not exists (
        select 1 from (select *, row_number() over (partition by question_id order by length(value) desc, value) as place
                       from {questions} q join {vocabulary} v on {named}) b
        where b.question_id = a.question_id and b.place < a.place and contains(lower(b.value), lower(a.value)))
      group by question_id"""


def _inputs(sql: str) -> str:
    sql = sql.replace("{empty}", "[]::varchar[]")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _case_null(condition: str, value: str) -> str:
    return f"case when {condition} then {value} end"


ESCAPED = "replace(replace(replace(x, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), chr(13), chr(92) || 'r')"
PAIR = rf"'(''Rated 4.0'', ''RATED\n  ' || {ESCAPED} || ''')'"
LITERAL = f"coalesce('[' || array_to_string(list_transform(string_split(lines, chr(10)), lambda x: {PAIR}), ', ') || ', (''alone'',), 7]', '[]')"

CTES = {
    "listing": f"select *, {LITERAL} as reviews from ({_inputs(inputs.LISTING)})",
    "question": _inputs(inputs.QUESTION),
    "explicit": _inputs(inputs.OVERRIDE),
    "parsed": rf"""
      select *, {tidy('name')} as clean_name,
        try_cast(nullif(regexp_extract(rate, '^{SPACE}*([0-9]+(?:\.[0-9]+)?){SPACE}*/{SPACE}*5{SPACE}*$', 1), '') as double) as rating,
        try_cast(nullif(regexp_extract(replace(cost, ',', ''), '^{SPACE}*([0-9]+){SPACE}*$', 1), '') as bigint) as price,
        cast(votes as bigint) as vote_count
      from listing""",
    "best": """
      select * from (
        select *, row_number() over (partition by clean_name, address order by vote_count desc, length(reviews) desc, url) as place,
          list_sort(list_distinct(list(category) over (partition by clean_name, address))) as categories
        from parsed) where place = 1""",
    "reviewed": f"select *, {reviews_of('lines')} as all_reviews from best",
    "entity": rf"""
      select substr(md5(clean_name || '|' || address), 1, 16) as entity_id, clean_name as name, address,
        coalesce(area, city) as area, city, kind, {split_tidy('tags')} as tags, {split_tidy('liked')} as liked,
        rating, vote_count as votes, price, online_order = 'Yes' as online_order, book_table = 'Yes' as book_table, categories,
        (regexp_matches(clean_name, '(?i){START}veg(?:etarian)?{END}') and not regexp_matches(clean_name, '(?i){START}non(?:-|{SPACE})*veg'))
          or len(list_filter(all_reviews, lambda x: regexp_matches(x, '(?i){START}pure(?:-|{SPACE})*veg(?:etarian)?{END}'))) > 0 as pure_veg,
        {excerpts_of('all_reviews')} as reviews, split_part(url, '?', 1) as url
      from reviewed""",
    "tag": "select distinct unnest(tags) as value from entity",
    "area": "select distinct area as value from entity where area <> ''",
    "headed": """
      select *, name || ' (' || case when kind = '' then 'Restaurant' else kind end || ') in ' || area || ', Bangalore. Cuisines: '
        || coalesce(nullif(array_to_string(tags, ', '), ''), 'unknown cuisine') || '.' as header,
      from entity""",
    "chunk": f"""
      select entity_id || '-profile' as chunk_id, 'profile' as chunk_type, header || chr(10)
        || 'Address: ' || address || '.' || chr(10)
        || coalesce('Rating: ' || cast(rating as varchar) || '/5 from ' || cast(votes as varchar) || ' votes.',
                    'Rating: not yet rated (new restaurant).') || chr(10)
        || coalesce('Approximate cost for two people: Rs. ' || cast(price as varchar) || '.',
                    'Approximate cost for two: not listed.') || chr(10)
        || 'Listed under: ' || coalesce(nullif(array_to_string(categories, ', '), ''), 'n/a') || '.' || chr(10)
        || 'Online ordering: ' || case when online_order then 'yes' else 'no' end
        || '. Table booking: ' || case when book_table then 'yes' else 'no' end || '.'
        || case when pure_veg then chr(10) || 'Described as a pure vegetarian restaurant.' else '' end
        || case when len(liked) > 0 then chr(10) || 'Popular dishes: ' || array_to_string(liked, ', ') || '.' else '' end as text,
        * exclude (header, reviews)
      from headed
      union all
      select entity_id || '-reviews-' || cast(i - 1 as varchar), 'reviews',
        header || chr(10) || 'Customer reviews:' || chr(10) || bodies[i], * exclude (header, reviews, bodies, i)
      from (select *, unnest(range(1, len(bodies) + 1)) as i from (select *, {packed_list('reviews')} as bodies from headed))""",
    "asked": f"select question_id, text, lower(text) as lowered, {scalars('lower(text)')} from question",
    "asked_tags": matched_tags("asked", "tag"),
    "area_base": rf"select value, trim(regexp_replace(value, '{SPACE}+[0-9].*$', '')) as base from area",
    "exact_area": f"""
      select question_id, value, first_value(value) over (partition by question_id order by length(value) desc, value) as longest
      from asked q join area v on {has_phrase('lowered', 'v.value')}""",
    "asked_areas": f"""
      select question_id, list(distinct value order by value) as areas from exact_area
      where value = longest or not contains(lower(longest), lower(value)) group by question_id
      union all
      select question_id, list(distinct value order by value) from asked q
      join area_base v on length(base) >= 3 and {has_phrase('lowered', 'v.base')}
      where question_id not in (select question_id from exact_area) group by question_id""",
    "filter": """
      select asked.*, coalesce(tags, []) as tags, coalesce(areas, []) as areas,
        case when trim(text) = '' then 'Query must not be empty.' end as error
      from asked left join asked_tags using (question_id) left join asked_areas using (question_id)""",
    "merged": """
      select f.question_id, f.text, f.error,
        case when len(o.tags) > 0 then o.tags else f.tags end as tags,
        case when len(o.areas) > 0 then o.areas else f.areas end as areas,
        coalesce(nullif(o.max_price, 0), f.max_price) as max_price, coalesce(nullif(o.min_rating, 0), f.min_rating) as min_rating,
        coalesce(o.pure_veg, false) or f.pure_veg as pure_veg, coalesce(o.online_order, false) or f.online_order as online_order,
        coalesce(o.book_table, false) or f.book_table as book_table,
        coalesce(o.sort_by_rating, false) or f.sort_by_rating as sort_by_rating
      from filter f left join explicit o on o.question_id = f.question_id""",
    "token": r"""
      select chunk_id as id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as token from chunk
      union all
      select 'q' || cast(question_id as varchar), unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) from merged""",
    "weight": """
      select id, slot, cast(n / sqrt(sum(n * n) over (partition by id)) as float) as w
      from (select id, cast('0x' || substr(md5(lower(token)), 1, 8) as bigint) % 64 as slot, cast(count(*) as double) as n
            from token group by all)""",
    "vector": """
      select id, list(cast(coalesce(w, 0) as double) order by s.slot) as v
      from (select distinct id from weight) i cross join (select unnest(range(64)) as slot) s
      left join weight using (id, slot) group by id""",
    "scored": """
      select m.question_id, m.sort_by_rating, c.chunk_id, c.entity_id, c.rating, c.votes,
        round(list_dot_product(a.v, b.v), 6) as similarity
      from merged m join vector a on a.id = 'q' || cast(m.question_id as varchar)
      join chunk c on (len(m.tags) = 0 or list_has_any(c.tags, m.tags)) and (len(m.areas) = 0 or list_contains(m.areas, c.area))
        and (m.max_price is null or c.price between 0 and m.max_price) and (m.min_rating is null or c.rating >= m.min_rating)
        and (not m.pure_veg or c.pure_veg) and (not m.online_order or c.online_order) and (not m.book_table or c.book_table)
      join vector b on b.id = c.chunk_id
      where m.error is null""",
    "hit": """
      select * from (
        select *, row_number() over (partition by question_id order by similarity desc, chunk_id) as position from scored)
      where position <= case when sort_by_rating then 60 else 30 end""",
    "grouped": """
      select question_id, entity_id, min(position) as first_position, max(similarity) as similarity, any_value(rating) as rating,
        any_value(votes) as votes, any_value(sort_by_rating) as sort_by_rating, string_agg(chunk_id, '|' order by position) as hits
      from hit group by question_id, entity_id""",
    "ranked": """
      select * from (
        select *, row_number() over (partition by question_id order by
          case when sort_by_rating then coalesce(rating, -1) end desc nulls last,
          case when sort_by_rating then votes end desc nulls last, first_position) as rank
        from grouped) where rank <= 5""",
    "evidence": """
      select h.question_id, h.entity_id, list(c.text order by h.position) as evidence
      from hit h join chunk c using (chunk_id) where c.chunk_type <> 'profile' group by h.question_id, h.entity_id""",
    "result": """
      select r.question_id, r.rank, r.entity_id, r.similarity, c.text as profile, coalesce(e.evidence, []) as evidence,
        c.name, c.area, c.kind, c.tags, c.rating, c.votes, c.price, c.pure_veg, c.url
      from ranked r join chunk c on c.chunk_id = r.entity_id || '-profile'
      left join evidence e on e.question_id = r.question_id and e.entity_id = r.entity_id""",
    "described": """
      select question_id, array_to_string(list_filter([
          case when len(tags) > 0 then '"tags":["' || array_to_string(tags, '","') || '"]' end,
          case when len(areas) > 0 then '"areas":["' || array_to_string(areas, '","') || '"]' end,
          '"max_price":' || cast(max_price as varchar), '"min_rating":' || cast(min_rating as varchar),
          case when pure_veg then '"pure_veg":true' end, case when online_order then '"online_order":true' end,
          case when book_table then '"book_table":true' end], lambda x: x is not null), ',') as body,
        array_to_string(list_filter([
          case when len(tags) > 0 then '**tags** = ["' || array_to_string(tags, '","') || '"]' end,
          case when len(areas) > 0 then '**areas** = ["' || array_to_string(areas, '","') || '"]' end,
          '**max_price** = ' || cast(max_price as varchar), '**min_rating** = ' || cast(min_rating as varchar),
          case when pure_veg then '**pure_veg** = true' end, case when online_order then '**online_order** = true' end,
          case when book_table then '**book_table** = true' end], lambda x: x is not null), ', ') as caption
      from merged""",
    "context": """
      select question_id, '<restaurants>' || chr(10) || coalesce(string_agg('<record number="' || cast(rank as varchar) || '">' || chr(10)
          || array_to_string(list_prepend(profile, evidence), chr(10)) || chr(10) || '</record>', chr(10) order by rank), '')
        || chr(10) || '</restaurants>' as context
      from (select question_id from merged) left join result using (question_id) group by question_id""",
}


def _uses(sql: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b(?:from|join) {name}\b", sql)}


def with_ctes(sql: str) -> str:
    """The query, led by the CTEs it needs in the order of their definition."""
    needed, queue = set(), list(_uses(sql))
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += _uses(CTES[name])
    if not needed:
        return sql
    parts = ", ".join(f"{name} as materialized ({CTES[name]})" for name in CTES if name in needed)
    return f"with {parts} {sql}"


def piped(column: str) -> str:
    return f"array_to_string({column}, '|') as {column}"


ENTITY = f"""
  select * replace (array_to_string(tags, '|') as tags, array_to_string(liked, '|') as liked,
    array_to_string(categories, '|') as categories, array_to_string(reviews, '|') as reviews) from entity"""
FILTER_COLUMNS = f"""
  question_id, {piped('tags')}, {piped('areas')}, max_price, min_rating, pure_veg, online_order, book_table, sort_by_rating, error"""
DOC_LINES = f"(select doc_id, {reviews_of('text')} as lines from documents)"
NAMES = "(select distinct unnest([lang, source]) as value from documents)"

def centres(count: int, rounds: int, sample: int) -> str:
    """The tables point and centre_0 to centre_<rounds>: whole components, and rounds of floored means over the first vectors."""
    tables = [f"""point as (select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 4096)) as p from embeddings where embedding is not null),
      sample as (select * from point order by vec_id limit {sample}),
      centre_0 as (select row_number() over (order by vec_id) - 1 as k, p as c from sample order by vec_id limit {count})"""]
    for r in range(rounds):
        tables.append(f"""own_{r} as (
        select vec_id, p, k from sample, centre_{r}
        qualify row_number() over (partition by vec_id order by list_dot_product(c, c) - 2 * list_dot_product(p, c), k) = 1),
      mean_{r} as (
        select k, list(x order by i) as m from (
          select k, i, floor(sum(x) / count(*)) as x from (select k, unnest(p) as x, generate_subscripts(p, 1) as i from own_{r}) group by k, i) group by k),
      centre_{r + 1} as (select k, coalesce(m, c) as c from centre_{r} left join mean_{r} using (k))""")
    return ",\n      ".join(tables)


SQL = {
    "parse_fields": """
      select address, category, rating, price, vote_count as votes, online_order = 'Yes' as online_order,
        book_table = 'Yes' as book_table from parsed""",
    "clean_text": f"select doc_id, cast(length({tidy('text')}) as integer) as chars, md5({tidy('text')}) as digest from documents",
    "repair_text": f"select doc_id, md5({tidy('text')}) as digest from documents",
    "url_paths": "select page_id, split_part(url, '?', 1) as path from pages",
    "split_tags": f"select address, category, array_to_string({split_tidy('tags')}, '|') as tags from listing",
    "entity_keys": "select address, category, substr(md5(clean_name || '|' || address), 1, 16) as entity_id from parsed",
    "best_listing": f"""
      select clean_name as name, address, vote_count as votes, url, {piped('categories')}, cast(length(reviews) as integer) as review_chars from best""",
    "best_document": """
      select name, lang, votes, lpad(cast(doc_id as varchar), 12, '0') as url, categories from (
        select md5(text) as name, lang, n_chars as votes, doc_id,
          row_number() over (partition by md5(text), lang order by n_chars desc, doc_id) as place,
          array_to_string(list_sort(list_distinct(list(source) over (partition by md5(text), lang))), '|') as categories
        from documents) where place = 1""",
    "clean_entities": ENTITY,
    "entities_csv": ENTITY,
    "flag_entities": "select entity_id, name, pure_veg from entity",
    "tag_vocab": "select value from tag",
    "area_vocab": "select value from area",
    "review_excerpts": f"""
      select doc_id, cast(i - 1 as integer) as position, items[i] as excerpt from (
        select doc_id, items, unnest(range(1, len(items) + 1)) as i from (select doc_id, {excerpts_of('lines')} as items from {DOC_LINES}))""",
    "literal_reviews": f"""
      select doc_id, cast(i - 1 as integer) as position, md5(lines[i]) as digest from (
        select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from {DOC_LINES})""",
    "packed_lines": f"""
      select doc_id, cast(i - 1 as integer) as position, cast(length(items[i]) as integer) as chars, md5(items[i]) as digest from (
        select doc_id, items, unnest(range(1, len(items) + 1)) as i from (select doc_id, {packed_list('lines')} as items from {DOC_LINES}))""",
    "entity_chunks": "select chunk_id, chunk_type, entity_id, text from chunk",
    "metadata_records": """
      select chunk_id, entity_id, name, address, area, city, kind, array_to_string(tags, ', ') as tags_text,
        coalesce(rating, -1.0) as rating, votes, coalesce(price, -1) as price, online_order, book_table, pure_veg,
        array_to_string(categories, ', ') as categories_text, url, array_to_string(tags, '|') as tags
      from chunk""",
    "hashed_embed": r"""
      select doc_id, cast(s.slot as integer) as slot, round(coalesce(w, 0), 6) as weight
      from documents cross join (select unnest(range(64)) as slot) s left join (
        select doc_id, slot, cast(cast(n / sqrt(sum(n * n) over (partition by doc_id)) as float) as double) as w from (
          select doc_id, cast('0x' || substr(md5(lower(token)), 1, 8) as bigint) % 64 as slot, cast(count(*) as double) as n
          from (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as token from documents) group by all)
      ) using (doc_id, slot)""",
    "l2_normalised": """
      select vec_id, cast(i - 1 as integer) as slot, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as value
      from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from (
        select vec_id, list_transform(embedding, lambda x: cast(x as double) * 3) as v from embeddings))""",
    "filter_single": """
      select entity_id, name, area, price, rating from entity
      where list_has_any(tags, ['red', 'small bolt', 'ring']) and area in ('ASIA', 'AFRICA 0th Block', 'EUROPE 3th Block', 'ASIA 2th Block')
        and price between 0 and 1200 and rating >= 3.2 and book_table""",
    "question_scalars": f"select question_id, {scalars('lower(text)')} from question",
    "document_scalars": f"select doc_id, {scalars('lower(text)')} from documents",
    "question_tags": "select question_id, array_to_string(coalesce(tags, []), '|') as tags from asked left join asked_tags using (question_id)",
    "question_areas": "select question_id, array_to_string(coalesce(areas, []), '|') as areas from asked left join asked_areas using (question_id)",
    "document_words": f"""
      select doc_id as question_id, array_to_string(coalesce(tags, []), '|') as tags from documents left join (
        {matched_tags("(select doc_id as question_id, text from documents)", NAMES)}) m on m.question_id = doc_id""",
    "parsed_questions": f"select {FILTER_COLUMNS} from filter",
    "merged_filters": f"select {FILTER_COLUMNS} from merged",
    "filter_captions": """
      select question_id, body = '' as is_empty, case when body <> '' then '{' || body || '}' end as description, caption from described""",
    "vector_topk": """
      select question_id, chunk_id, similarity, cast(position as integer) as position from (
        select *, row_number() over (partition by question_id order by similarity desc, chunk_id) as position from (
          select q.vec_id as question_id, c.vec_id as chunk_id,
            round(list_dot_product(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as similarity
          from embeddings q cross join embeddings c)) where position <= 5""",
    "lsh_topk": f"""
      with {centres(128, 3, 16384)}, close as (
        select vec_id, k, row_number() over (partition by vec_id order by list_dot_product(c, c) - 2 * list_dot_product(p, c), k) as near
        from point, centre_3),
      home as (select vec_id, k from close where near = 1)
      select question_id, chunk_id, similarity, cast(position as integer) as position from (
        select *, row_number() over (partition by question_id order by similarity desc, chunk_id) as position from (
          select q.vec_id as question_id, c.vec_id as chunk_id,
            round(list_dot_product(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as similarity
          from close r join embeddings q using (vec_id) join home on home.k = r.k join embeddings c on c.vec_id = home.vec_id
          where r.near <= 49)) where position <= 5""",
    "phrase_tokens": r"""
      select kind, value, phrase, arg_min(token, {'n': n, 'size': -length(token), 'token': token}) as token from (
        select *, count(*) over (partition by token) as n from (
          select kind, value, phrase, unnest(list_distinct(regexp_extract_all(phrase, '[a-z0-9]+|[^a-z0-9 ]'))) as token
          from (
            select 'tag' as kind, value, lower(value) as phrase from tag
            union all select 'tag', value, lower(value) || 's' from tag
            union all select 'area', value, lower(value) from area
            union all select 'base', value, lower(base) from area_base where length(base) >= 3)))
      group by kind, value, phrase""",
    "filtered_topk": "select question_id, cast(position as integer) as position, chunk_id, similarity from hit",
    "grouped_hits": "select question_id, entity_id, cast(first_position as integer) as first_position, similarity, hits from grouped",
    "ranked_entities": "select question_id, cast(rank as integer) as rank, entity_id, similarity from ranked",
    "retrieve": f"""
      select question_id, cast(rank as integer) as rank, entity_id, similarity, md5(profile) as profile,
        cast(len(evidence) as integer) as evidence_count, md5(array_to_string(evidence, chr(10))) as evidence,
        name, area, {piped('tags')}, rating, votes, price from result""",
    "source_table": """
      select question_id, cast(rank as integer) as number, name, area, array_to_string(tags, ', ') as tags, kind, price, rating, votes,
        case when pure_veg then 'yes' else '' end as pure_veg, round(similarity, 3) as similarity, url from result""",
    "prompt_contexts": "select question_id, cast(length(context) as integer) as chars, md5(context) as digest from context",
    "prompts": """
      select question_id, cast(length(prompt) as integer) as chars, md5(prompt) as digest from (
        select question_id, context || chr(10) || chr(10) || case when body <> '' then
          'Filters already applied to the search: {' || body || '}' || chr(10) || chr(10) else '' end || 'Question: ' || text as prompt
        from merged join described using (question_id) join context using (question_id) where error is null)""",
    "list_answers": """
      select question_id, case when count(rank) = 0 then 'I couldn''t find any restaurants in the dataset matching that request.'
        else 'Here are the best matches from the dataset:' || chr(10) || chr(10) || string_agg('- **' || name || '** [' || cast(rank as varchar)
          || ']: ' || kind || ' in ' || area || ' · ' || array_to_string(tags, ', ') || ' · '
          || coalesce('Rs. ' || cast(price as varchar) || ' for two', 'cost not listed') || ' · '
          || coalesce(cast(rating as varchar) || '/5 (' || cast(votes as varchar) || ' votes)', 'not yet rated'), chr(10) order by rank) end as answer
      from (select question_id, error from merged) left join result using (question_id) where error is null group by question_id""",
    "ingest_counts": """
      select (select count(*) from listing) as raw_rows, (select count(*) from entity) as entities,
        (select count(*) from chunk) as chunks, (select count(*) from chunk) as stored""",
    "top_entities": """
      select substr(md5(clean_name || '|' || address), 1, 16) as entity_id, clean_name as name, vote_count as votes, split_part(url, '?', 1) as url,
        array_to_string(reviews, '|') as reviews
      from (select b.* exclude (reviews), length(b.reviews) as chars, e.reviews from best b join entity e on e.entity_id = substr(md5(b.clean_name || '|' || b.address), 1, 16))
      order by vote_count desc, chars desc, clean_name, address limit 100""",
    "csv_scan": "select * exclude (lines, reviews) replace (nullif(kind, 'N/A') as kind), md5(reviews) as reviews from listing",
}
SQL = {name: with_ctes(sql) for name, sql in SQL.items()}
