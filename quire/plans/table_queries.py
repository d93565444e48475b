"""Column functions over the given tables: the same expressions as over their fixtures, on values that the tables hold or that are put together from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import adapters as A
from quire.sources import markup as M
from quire.sources import printed as P

from . import change_queries, field_queries, match_queries, render_queries, structure_queries, text_queries, tree_queries
from .fixture import Fixture, Registry, Source

R = Registry()
TEXT, FIELD, RENDER, STRUCTURE = text_queries.R, field_queries.R, render_queries.R, structure_queries.R


def _str(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _part(unit: str, width: int = 2) -> str:
    return f"lpad(CAST(EXTRACT({unit} FROM o_orderdate) AS STRING), {width}, '0')"


def _pick(key: str, *values: str) -> str:
    """One of the values by the remainder of a number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _box(key: str, *names: str) -> str:
    """Edges of boxes that overlap now and then, as doubles."""
    steps = {"l": (37, 300, 20), "b": (53, 500, 30), "r": (37, 300, 140), "t": (53, 500, 48), "l2": (41, 320, 10), "b2": (59, 480, 20), "r2": (41, 320, 150), "t2": (59, 480, 44)}
    return ", ".join(f"CAST(({key} * {steps[n][0]}) % {steps[n][1]} + {steps[n][2]} AS DOUBLE) AS {n}" for n in names)


DOCUMENTS = "SELECT doc_id AS id, text AS x FROM documents"
NAMES = f"SELECT p_partkey AS id, concat({_pick('p_partkey', chr(39) + 'form.' + chr(39), chr(39) * 2, chr(39) + 'a.b.' + chr(39))}, {_pick('p_partkey', 'replace(p_name, chr(32), chr(95))', 'concat(lower(p_type), p_brand)', chr(39) + 'Text' + chr(39), 'replace(p_brand, chr(35), chr(46))')}, {_pick('p_partkey', chr(39) * 2, _str('p_size'))}) AS x FROM part"
TYPED = f"""concat({_part('DAY')}, '/', {_part('MONTH')}, '/', {_part('YEAR', 4)})|concat({_part('YEAR', 4)}, '-', {_part('MONTH')}, '-', {_part('DAY')})|concat({_part('MONTH')}, '/', {_part('DAY')}, '/', {_part('YEAR', 4)})|{_str('o_custkey')}|concat('-', {_str('o_custkey')}, '.50')|concat('£', {_str('o_custkey')}, ',000.25')
|concat(lpad({_str('o_orderkey % 27')}, 2, '0'), ':', lpad({_str('o_custkey % 63')}, 2, '0'))|concat({_str('o_orderkey % 13')}, '.30 pm')|concat(lower(o_orderstatus), {_str('o_custkey')}, '@example.org')|concat(o_orderpriority, ' @example')|concat('+44 20 7946 ', lpad({_str('o_custkey')}, 4, '0'))|concat('0', {_str('o_custkey * 7919')})|o_orderpriority|''""".replace("\n", "").split("|")
TYPED_X = _pick("o_orderkey", *TYPED)
FORMATS = ("'Date'", "'Number'", "'Currency'", "'DigitsOnly'", "'Time'", "'Email'", "'Telephone'", "'PlainText'", "'Comb'")

for _name, _of, _source in (
    ("t01_normalise_whitespace_of_documents", "t01_normalise_whitespace", DOCUMENTS), ("t02_speech_of_documents", "t02_prepare_for_speech", DOCUMENTS), ("t04_truncated_documents", "t04_truncate", DOCUMENTS), ("t06_shortened_documents", "t06_shorten", DOCUMENTS),
    ("t19_escaped_documents", "t19_html_escape", DOCUMENTS), ("t21_fonts_of_documents", "t21_standard_font", DOCUMENTS), ("t22_literals_of_documents", "t22_literal_string", DOCUMENTS), ("t16_characters_of_documents", "t16_spell_character", "SELECT doc_id AS id, substr(text, CAST(1 + doc_id % 40 AS INT), 1) AS x FROM documents"),
    ("t08_names_of_parts", "t08_humanise_name", NAMES), ("t09_names_of_parts", "t09_readable_name", NAMES), ("t20_names_of_parts", "t20_partial_name", NAMES), ("t07_labels_of_suppliers", "t07_tidy_label", "SELECT s_suppkey AS id, concat(' * ', s_name, ' ‡: ') AS x FROM supplier"),
    ("t10_labels_of_parts", "t10_label_resolution", f"SELECT p_partkey AS id, {_pick('p_partkey', 'p_name', 'NULL', chr(39) + ' ' + chr(39))} AS tooltip, {_pick('p_size', 'NULL', 'p_type', chr(39) * 2)} AS recovered, concat('f.', replace(p_name, ' ', '_')) AS name FROM part"),
    ("t11_links_of_conversations", "t11_uninformative_text", f"SELECT conv_id * 1000 + turn AS id, {_pick('turn', 'substr(text, 1, 90)', 'role', chr(39) + ' Click here ' + chr(39))} AS x FROM conversations"),
    ("t12_targets_of_pages", "t12_speakable_target", f"SELECT page_id AS id, {_pick('page_id', chr(39) + 'WebUrl' + chr(39), chr(39) + 'Email' + chr(39))} AS kind, concat(url, {_pick('page_id', chr(39) * 2, chr(39) + '/' + chr(39), chr(39) + '/a/b?c=1#d' + chr(39))}) AS x FROM pages"),
    ("t13_targets_of_pages", "t13_classify_uri", f"SELECT page_id AS id, concat({_pick('page_id', chr(39) * 2, chr(39) + 'mailto:' + chr(39), chr(39) + ' FILE:' + chr(39), chr(39) + 'javascript:' + chr(39))}, url) AS x FROM pages"),
    ("t14_actions_of_events", "t14_classify_action", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'GoTo' WHEN 'click' THEN 'URI' WHEN 'error' THEN 'Launch' WHEN 'signup' THEN 'JavaScript' ELSE event_type END AS x FROM events"),
    ("t15_sizes_of_orders", "t15_spoken_size", "SELECT o_orderkey AS id, (o_orderkey * o_orderkey * 7919) % 6000000000 AS x FROM orders"),
    ("t17_dates_of_orders", "t17_pdf_date_parse", f"SELECT o_orderkey AS id, concat({_pick('o_orderkey', chr(39) + 'D:' + chr(39), chr(39) * 2)}, {_part('YEAR', 4)}, {_part('MONTH')}, {_pick('o_orderkey', _part('DAY'), chr(39) * 2, chr(39) + '31' + chr(39))}, {_pick('o_orderkey', chr(39) * 2, chr(39) * 2, chr(39) * 2, chr(39) + '143005Z' + chr(39))}) AS x FROM orders"),
    ("t18_dates_of_orders", "t18_pdf_date_format", "SELECT o_orderkey AS id, o_orderdate AS ts, (o_orderkey % 27 - 13) * 30 AS off FROM orders"),
    ("t23_languages_of_documents", "t23_language_name", "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN concat(lang, '-GB') ELSE lang END AS x FROM documents"),
    ("t24_roles_of_customers", "t24_role_name", f"SELECT c_custkey AS id, {_pick('c_custkey', *(chr(39) + k + chr(39) for k in ('Heading', 'Paragraph', 'List', 'TableCell', 'Figure', 'FormField', 'Link', 'Other')))} AS kind, '' AS content, '' AS state, '' AS pos, '' AS verbosity FROM customer"),
    ("t25_descriptions_of_customers", "t25_describe", f"SELECT c_custkey AS id, {_pick('c_custkey', *(chr(39) + k + chr(39) for k in ('Heading', 'Paragraph', 'Figure', 'Link', 'Other')))} AS kind, {_pick('c_custkey', 'c_name', chr(39) + ' ' + chr(39), 'NULL')} AS content, {_pick('c_nationkey', 'c_mktsegment', 'NULL')} AS state, concat('item ', {_str('c_nationkey + 1')}) AS pos, {_pick('c_nationkey', *(chr(39) + v + chr(39) for v in ('Terse', 'Normal', 'Detailed')))} AS verbosity FROM customer"),
    ("t31_locations_of_lineitems", "t31_field_location", f"SELECT l_orderkey * 10 + l_linenumber AS id, {_box('(l_partkey + l_linenumber)', 'l', 'b', 'r', 't')}, CAST(842 AS DOUBLE) AS h FROM lineitem"),
    ("t36_sizes_of_parts", "t36_appearance_size", f"SELECT p_partkey AS id, {_pick('p_partkey', 'concat(' + chr(39) + '/Helv ' + chr(39) + ', ' + _str('p_size') + ', ' + chr(39) + ' Tf 0 g' + chr(39) + ')', 'NULL', chr(39) + '/F1 0 Tf' + chr(39))} AS da, CAST(p_size AS DOUBLE) AS height FROM part"),
):
    R.over(_name, TEXT, _of, _source)

_ORDERS = f"SELECT o_orderkey AS id, {TYPED_X} AS x FROM orders"
for _name, _of, _source in (
    *((f"{n}_of_orders", n, _ORDERS) for n in ("v03_number", "v04_currency", "v05_digits", "v06_date", "v07_time", "v08_email", "v09_telephone")),
    *((f"{n}_of_orders", n, f"SELECT o_orderkey AS id, {TYPED_X} AS x, {_pick('o_custkey', *FORMATS)} AS fmt, {_pick('o_custkey', 'NULL', '8', '20')} AS most, o_custkey % 5 = 0 AS multi, o_orderkey % 11 = 0 AS ro FROM orders") for n in ("v01_set_value_gate", "v02_text_apply")),
    ("v10_formats_of_parts", "v10_format_inference", f"SELECT p_partkey AS id, {_pick('p_partkey', 'p_name', chr(39) + 'Email address' + chr(39), chr(39) + 'Date of birth' + chr(39), 'NULL')} AS tooltip, concat({_pick('p_size', chr(39) + 'phone_' + chr(39), chr(39) + 'amount_' + chr(39), chr(39) * 2)}, p_type) AS name, p_partkey % 13 = 0 AS comb FROM part"),
    ("v11_words_of_events", "v11_checkbox_words", f"SELECT event_id AS id, {_pick('event_id', chr(39) + 'yes' + chr(39), chr(39) + ' Off' + chr(39), 'event_type', chr(39) + 'TRUE' + chr(39), chr(39) * 2)} AS x, 'click' AS on_name, 'error' AS off_name FROM events"),
    ("v16_attention_of_events", "v16_needs_attention", "SELECT event_id AS id, event_id % 2 = 0 AS ro, user_id % 2 = 0 AS req, event_id % 3 = 0 AS val, user_id % 5 = 0 AS bad FROM events"),
    *((n, of, f"SELECT p_partkey AS id, p_partkey % 5 = 0 AS deco, {_pick('p_partkey', 'p_name', 'NULL', chr(39) + ' ' + chr(39), chr(39) + 'Image' + chr(39))} AS alt, CAST(p_size AS DOUBLE) AS w, {_pick('p_size', 'NULL', 'p_size * 2', '4')} AS px FROM part") for n, of in (("v17_images_of_parts", "v17_alt_needed"), ("g07_images_of_parts", "g07_decorative_by_size"), ("v20_descriptions_of_parts", "v20_alt_text_input"))),
    ("v18_buttons_of_events", "v18_button_policy", f"SELECT event_id AS id, {_pick('event_id', *(chr(39) + a + chr(39) for a in ('SubmitForm', 'ResetForm', 'OpenUrl', 'Named', 'JavaScript')))} AS action, {_pick('user_id', 'NULL', 'concat(' + chr(39) + 'https://example.org/' + chr(39) + ', event_type)', chr(39) + ' ' + chr(39))} AS target FROM events"),
    ("v19_links_of_pages", "v19_link_policy", f"SELECT page_id AS id, {_pick('page_id', *(chr(39) + a + chr(39) for a in ('WebUrl', 'Email', 'InternalDestination', 'UnsupportedAction', 'ExternalFile')))} AS kind, {_pick('page_id', 'url', chr(39) + 'a@b.org' + chr(39), chr(39) * 2)} AS x, {_pick('page_id', 'NULL', '3')} AS page FROM pages"),
    ("t32_guidance_of_parts", "t32_field_guidance", f"SELECT p_partkey AS id, p_partkey % 2 = 0 AS req, {_pick('p_partkey', *FORMATS)} AS fmt, {_pick('p_size', 'NULL', 'p_size')} AS most, p_partkey % 7 = 0 AS multi FROM part"),
    ("t27_texts_in_speech_of_documents", "t27_value_in_speech", "SELECT doc_id AS id, text AS x, doc_id % 7 = 0 AS pw, doc_id % 2 = 0 AS multi FROM documents"),
    *((n, of, f"SELECT l_orderkey * 10 + l_linenumber AS id, {_box('(l_partkey * 3 + l_linenumber)', 'l', 'b', 'r', 't', 'l2', 'b2', 'r2', 't2')} FROM lineitem") for n, of in (("g01_boxes_of_lineitems", "g01_region_algebra"), ("g02_lines_of_lineitems", "g02_shares_line"))),
    ("g03_boxes_of_lineitems", "g03_image_rectangle", f"SELECT l_orderkey * 10 + l_linenumber AS id, {_box('l_partkey', 'l', 'b', 'r', 't')}, CAST(595 AS DOUBLE) AS w, CAST(842 AS DOUBLE) AS h, CAST(2 AS DOUBLE) AS s, CAST(l_linenumber AS DOUBLE) AS pad FROM lineitem"),
    ("g06_pitch_of_events", "g06_pitch", "SELECT event_id AS id, 1 AS stroke, CAST(event_id % 101 AS DOUBLE) / 80 AS x, CAST(user_id % 61 AS DOUBLE) / 50 AS y FROM events"),
):
    R.over(_name, FIELD, _of, _source)

_OPEN = f"SELECT c_custkey AS id, c_name AS name, 1 + c_nationkey AS pages, {_pick('c_custkey', *(chr(39) + s + chr(39) for s in ('FullyTagged', 'Untagged', 'PartiallyTagged', 'ScannedWithoutText', 'Unknown')))} AS status, c_custkey % 6 AS fields, c_custkey % 3 AS open_fields, c_nationkey % 4 AS headings, c_custkey % 2 AS comments FROM customer"
for _name, _of, _source in (
    ("h12_heads_of_customers", "h12_document_head", f"SELECT c_custkey AS id, {_pick('c_custkey', 'concat(c_name, ' + chr(39) + ' & <sons>' + chr(39) + ')', chr(39) + ' ' + chr(39), 'NULL')} AS title, concat(c_mktsegment, '.pdf') AS file, {_pick('c_nationkey', chr(39) + 'en-GB' + chr(39), 'NULL')} AS lang FROM customer"),
    ("t28_openings_of_customers", "t28_opening_announcement", _OPEN), ("t34_form_lines_of_customers", "t34_form_list_line", _OPEN), ("t35_summaries_of_customers", "t35_summary_sentences", _OPEN),
    ("t37_comments_of_lineitems", "t37_comment_rectangle", f"SELECT l_orderkey * 10 + l_linenumber AS id, {_pick('l_linenumber', *(chr(39) + k + chr(39) for k in ('Comment', 'Highlight', 'Stamp')))} AS kind, {_box('l_partkey', 'l', 'b', 'r', 't')} FROM lineitem"),
):
    R.over(_name, RENDER, _of, _source)

_LINES = "SELECT doc_id AS id, substr(text, 1, CAST(20 + doc_id % 150 AS INT)) AS x, CAST(100 + doc_id % 80 AS DOUBLE) / 100 AS ratio, doc_id % 3 = 0 AS bold, CAST(1 + doc_id % 5 AS INT) AS lines FROM documents"
for _name, _of, _source in (
    ("c06_headings_of_documents", "c06_heading_level", _LINES), ("c07_reasons_of_documents", "c07_heading_reason", _LINES),
    ("c09_fonts_of_parts", "c09_monospaced", f"SELECT p_partkey AS id, concat({_pick('p_partkey', chr(39) + 'ABCDEE+' + chr(39), chr(39) * 2)}, {_pick('p_size', 'p_type', chr(39) + 'Courier ' + chr(39), chr(39) + 'DejaVuSansMono' + chr(39))}, p_brand) AS x FROM part"),
):
    R.over(_name, STRUCTURE, _of, _source)


# ---- Queries over tables in place of their fixtures -------------------------------------------------------------------------
def _instead(names: str, module, suffix: str, **sources: Source) -> None:
    """Queries of a module, each with the module's fixtures of the given names replaced."""
    found: dict[int, tuple[Fixture, Source]] = {id(getattr(module, n)): (getattr(module, n), s) for n, s in sources.items()}
    for name in names.split():
        R.instead(f"{name}_of_{suffix}", (module.R, name), found)


def _split(columns: str) -> list[str]:
    """The expressions of a select list, parted at the commas outside brackets and quotes."""
    out, depth, quote, now = [], 0, False, ""
    for c in columns.replace("\n", " "):
        quote ^= c == "'"
        depth += (c == "(") - (c == ")") if not quote else 0
        if c == "," and not depth and not quote:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers have the type that fixtures cast them to before texts are dealt out by them: a cast afterwards would have all words dealt out again.
    return A.read(spark, sf_dir, "documents", F.col("doc_id").cast("int").alias("doc_id"), "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.printed_words(_documents(spark, sf_dir))
    return w.withColumns({"word_ord": F.col("true_ord") % P.PER_PAGE, "font": F.when(F.col("part") == 0, "Arial-Bold").otherwise("Times"), "italic": F.col("true_ord") % 7 < 4})


def _page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.printed_pages(_documents(spark, sf_dir)).select("doc_id", "page_no", F.lit(P.WIDTH).alias("width"), F.lit(P.HEIGHT).alias("height"))


WORDS = Source(f"SELECT *, true_ord % {P.PER_PAGE} AS word_ord, CASE WHEN part = 0 THEN 'Arial-Bold' ELSE 'Times' END AS font, true_ord % 7 < 4 AS italic FROM {P.PRINTED_SQL}", _words)
SIZES = Source(f"SELECT doc_id, page_no, {P.WIDTH} AS width, {P.HEIGHT} AS height FROM {P.PRINTED_SQL} GROUP BY 1, 2", _page_sizes)
_instead("c01_body_size c02_a02_left_margin c03_c04_block_type s04_lines_of_words", structure_queries, "documents", WORDS=WORDS)
_FOOT = "SELECT doc_id, page_no, 200 + k AS word_ord, CASE k WHEN 0 THEN 'Page' ELSE CAST(page_no AS STRING) END AS text, 280.0 + 30 * k AS l, 30.0 AS b, 300.0 + 30 * k AS r, 40.0 AS t, 'Times' AS font, 8.0 AS size, FALSE AS bold, FALSE AS italic"


def _with_feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed words with a page number at the foot of each page."""
    w = _words(spark, sf_dir)
    # The foot goes along with a page's first word, so that the words are made once.
    w = w.withColumn("k", F.explode(F.when(F.col("word_ord") == 0, F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(-1)))))
    feet = {(c.split(" AS ")[-1]).strip(): F.expr(c) for c in _split(_FOOT.removeprefix("SELECT "))}
    return w.select(*(F.when(F.col("k") < 0, F.col(n)).otherwise(c).alias(n) for n, c in feet.items()))


FEET = Source(f"SELECT doc_id, page_no, word_ord, text, l, b, r, t, font, size, bold, italic FROM ({WORDS.sql}) UNION ALL {_FOOT.replace(' AS STRING)', ' AS VARCHAR)')} FROM (SELECT DISTINCT doc_id, page_no FROM {P.PRINTED_SQL}), unnest([0, 1]) AS q(k)", _with_feet)
_instead("c05_a03_furniture_words c05_furniture_lines c14_j13_mark_furniture", structure_queries, "documents", WORDS=FEET, PAGES=SIZES)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.page_tree(A.customer_pages(spark, sf_dir)).filter("kind <> 'Run'")


TREE_SQL = f"(SELECT * FROM {M.tree_sql(f'({A.CUSTOMER_PAGES})')} WHERE kind <> 'Run')"
_BOX = "CASE WHEN last_id = element_id THEN 10.0 + element_id ELSE 0.0 END"
_TREE_COLUMNS = f"""doc_id, element_id, parent_id, sibling_ord, kind, CASE WHEN kind = 'Heading' THEN CAST(substr(tag, 2, 1) AS INT) END AS level, CASE tag WHEN 'th' THEN 'ColumnHeader' WHEN 'td' THEN 'Data' END AS role, text, 1 AS page_no, {_BOX} AS l, {_BOX} AS b, 2 * {_BOX} AS r, 3 * {_BOX} AS t,
kind = 'FormField' AND element_id % 4 = 0 AS needs_attention, CAST(NULL AS STRING) AS annotation_kind"""
TREE = Source(f"SELECT {_TREE_COLUMNS} FROM {TREE_SQL}", lambda s, d: _tree(s, d).selectExpr(*_split(_TREE_COLUMNS)))
_ELEMENT_COLUMNS = "doc_id, element_id, parent_id, 1 + element_id % 2 AS page_no, kind, CASE WHEN kind = 'Paragraph' AND element_id % 3 = 0 THEN ' ' ELSE text END AS text, tag <> '#text' AS from_tags"
ELEMENTS = Source(f"SELECT {_ELEMENT_COLUMNS} FROM {TREE_SQL}", lambda s, d: _tree(s, d).selectExpr(*_split(_ELEMENT_COLUMNS)))
_TAG_COLUMNS = """doc_id, element_id, 1 AS page_no, CASE kind WHEN 'Paragraph' THEN 'P' WHEN 'List' THEN 'L' WHEN 'ListItem' THEN 'LI' WHEN 'TableRow' THEN 'TR' WHEN 'Section' THEN 'Sect' WHEN 'Link' THEN 'Span' WHEN 'Label' THEN '' ELSE upper(tag) END AS tag, CASE WHEN element_id % 3 = 0 THEN 'Row' WHEN element_id % 3 = 1 THEN 'Column' END AS scope,
CASE WHEN element_id % 2 = 0 THEN 'UpperRoman' END AS numbering, CASE WHEN element_id % 5 = 0 THEN 'Footer' END AS subtype, CASE WHEN element_id % 4 = 0 THEN text END AS actual_text, CASE WHEN element_id % 7 = 0 THEN concat(text, ' ') END AS expanded, CASE WHEN element_id % 6 = 0 THEN ' fr ' END AS lang, CASE WHEN kind = 'Figure' THEN concat(' ', text) END AS alt"""
TAGS = Source(f"SELECT {_TAG_COLUMNS} FROM {TREE_SQL}", lambda s, d: _tree(s, d).selectExpr(*_split(_TAG_COLUMNS)))


_instead("c13_remove_empties c22_image_only_pages c23_tagged_status", structure_queries, "pages", ELEMENTS=ELEMENTS)
_instead("c15_strategy c16_c17_c19_c20_tags", structure_queries, "pages", TAGGED=TAGS)
_instead("g04_bounds_roll_up n01_n02_next_links n05_position_in_tree", tree_queries, "pages", TREE=TREE)
_instead("c21_o03_tab_order", structure_queries, "lineitems", FIELDS=Source("SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey % 1000000 AS field_id, 1 + l_linenumber % 2 AS page_no, CAST(l_suppkey % 9 AS DOUBLE) AS l, CAST(l_partkey % 7 AS DOUBLE) AS t FROM lineitem"))
_TOP = "CAST(l_partkey % 97 AS DOUBLE) AS t FROM lineitem"
_instead("c24_insert_tables", structure_queries, "lineitems", BLOCKTOPS=Source(f"SELECT l_orderkey AS doc_id, 1 AS page_no, l_linenumber AS ord, {_TOP}"), TABLETOPS=Source(f"SELECT l_orderkey AS doc_id, 1 AS page_no, l_linenumber AS table_id, CAST(l_suppkey % 89 AS DOUBLE) AS t FROM lineitem"))
OPTIONS = Source("SELECT n_regionkey AS field, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, concat('N', CAST(n_nationkey AS STRING)) AS export, n_name AS display FROM nation")
ASKED = Source("SELECT c_custkey AS id, n_regionkey AS field, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN concat('n', CAST(c_nationkey AS STRING)) WHEN 3 THEN substr(n_name, 1, CAST(1 + c_custkey % 11 AS INT)) ELSE '' END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey")
_instead("v12_radio_match v13_choice_match", field_queries, "customers", OPTIONS=OPTIONS, ASKED=ASKED)
_instead("v14_multi_choice", field_queries, "customers", OPTIONS=OPTIONS, MULTI=Source("SELECT c_custkey AS id, n_regionkey AS field, CASE c_custkey % 3 WHEN 0 THEN concat(n_name, '; ', lower(n_name)) WHEN 1 THEN concat('N', CAST(c_nationkey AS STRING), ';nowhere') ELSE ' ;' END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey"))
_instead("v15_select_by_index", field_queries, "customers", OPTIONS=OPTIONS, PICKS=Source("SELECT c_custkey AS id, n_regionkey AS field, c_custkey % 8 - 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"))
LOG = Source("SELECT user_id AS doc_id, event_id AS seq, ts AS made_at, CASE event_id % 7 WHEN 0 THEN 'SetFieldValue' WHEN 1 THEN 'AddAnnotation' WHEN 2 THEN 'DeleteAnnotation' WHEN 3 THEN 'FlattenSignature' WHEN 4 THEN 'SetHeadingLevel' WHEN 5 THEN 'AddTag' ELSE 'SetAltText' END AS op, concat('t', CAST(event_id % 23 AS STRING)) AS target, event_type AS value, event_id % 3 = 0 AS is_unsaved, event_id % 2 = 0 AS real_tags FROM events")
_instead("f06_expected_changes e01_state_of_log a05_e06_highest_risk e07_deleted_annotations", change_queries, "events", LOG=LOG)
CHANGED = Source("SELECT c_nationkey AS doc_id, c_name AS name, c_mktsegment AS value, c_custkey % 9 = 0 AS pending_signature FROM customer")
SAVED = Source("SELECT c_nationkey AS doc_id, c_name AS name, c_custkey AS raw_id FROM customer WHERE c_custkey % 4 <> 1")
_instead("j10_missing_fields j11_edited_fields", match_queries, "customers", CHANGED=CHANGED, SAVED=SAVED)
_instead("j07_span_at_offset", match_queries, "lineitems", SPANS=Source("SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS element_id, l_linenumber * 10 AS start, 3 + l_linenumber AS length FROM lineitem"), PLACES=Source("SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 9 AS position FROM lineitem"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict:
    return R.sql

