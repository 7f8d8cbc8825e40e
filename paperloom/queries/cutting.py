"""DuckDB views that cut sections into passages, from a view ``sect`` (paper_id, section_index, section_type, content)."""

from __future__ import annotations

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def cut_views(size: int, overlap: int, least: int) -> dict[str, str]:
    """``passages`` (paper_id, chunk_index, section_type, content, token_count), numbers from 0 over a paper."""
    return {
        "cut_body": f"""
            SELECT *, len(regexp_split_to_array(content, '\\s+')) AS tokens
            FROM (SELECT paper_id, section_index, section_type, {_TRIM.format('content')} AS content FROM sect)
            WHERE content <> '' AND section_type <> 'references'""",
        # Sentences of the sections over the budget, with the words up to each one.
        "cut_sentences": f"""
            SELECT paper_id, section_index, p, i, {_TRIM.format('s')} AS s FROM (
              SELECT paper_id, section_index, p, unnest(str_split(marked, chr(1))) AS s, unnest(range(len(str_split(marked, chr(1))))) AS i
              FROM (SELECT paper_id, section_index, p, regexp_replace({_TRIM.format('par')}, '([.!?])\\s+([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g') AS marked
                    FROM (SELECT paper_id, section_index, unnest(str_split(content, chr(10) || chr(10))) AS par,
                                 unnest(range(len(str_split(content, chr(10) || chr(10))))) AS p FROM cut_body WHERE tokens > {size})))
            WHERE trim(s) <> ''""",
        "cut_sections": """
            SELECT paper_id, section_index, list(s ORDER BY p, i) AS parts, list(c ORDER BY p, i) AS costs,
                   list_prepend(0::HUGEINT, list(t ORDER BY p, i)) AS total, count(*) AS n
            FROM (SELECT *, sum(c) OVER (PARTITION BY paper_id, section_index ORDER BY p, i) AS t
                  FROM (SELECT *, len(regexp_split_to_array(s, '\\s+')) AS c FROM cut_sentences))
            GROUP BY paper_id, section_index""",
        # One step: the range from ``start`` that holds all sentences before ``least_stop`` goes on while it fits.
        "cut_steps": f"""
            SELECT paper_id, section_index, 0::BIGINT AS step, 0::BIGINT AS start, 0::BIGINT AS least_stop,
                   coalesce(list_min(list_filter(range(0, n), lambda j: costs[j + 1] > {size} OR total[j + 2] > {size})), n) AS stop
            FROM cut_sections
            UNION ALL
            SELECT paper_id, section_index, step, start, least_stop,
                   coalesce(list_min(list_filter(range(least_stop, n), lambda j: costs[j + 1] > {size} OR total[j + 2] - total[start + 1] > {size})), n)
            FROM (SELECT t.paper_id, t.section_index, step + 1 AS step, c.n, c.costs, c.total, stop + 1 AS least_stop,
                         CASE WHEN c.costs[stop + 1] > {size} THEN stop + 1
                              ELSE list_min(list_filter(range(start, stop + 1), lambda b: c.total[stop + 1] - c.total[b + 1] <= {overlap})) END AS start
                  FROM cut_steps t JOIN cut_sections c ON c.paper_id = t.paper_id AND c.section_index = t.section_index AND t.stop < c.n)""",
        "cut_ranges": f"""
            SELECT paper_id, section_index, step, 0 AS half, start AS a, stop AS b FROM cut_steps WHERE stop > start
            UNION ALL
            SELECT t.paper_id, t.section_index, step, 1, stop, stop + 1
            FROM cut_steps t JOIN cut_sections c ON c.paper_id = t.paper_id AND c.section_index = t.section_index
            WHERE stop < n AND costs[stop + 1] > {size}""",
        "cut_pieces": f"""
            SELECT paper_id, section_index, list(piece ORDER BY step, half, w) AS pieces, list(k ORDER BY step, half, w) AS counts,
                   list_prepend(0::HUGEINT, list(t ORDER BY step, half, w)) AS total, count(*) AS n
            FROM (SELECT *, sum(k) OVER (PARTITION BY paper_id, section_index ORDER BY step, half, w) AS t FROM (
                    SELECT paper_id, section_index, step, half, w, CASE WHEN len(words) <= {size} THEN joined ELSE array_to_string(words[w + 1 : w + {size}], ' ') END AS piece,
                           least({size}, len(words) - w) AS k
                    FROM (SELECT *, unnest(range(0, len(words), {size})) AS w FROM (
                            SELECT *, regexp_split_to_array(joined, '\\s+') AS words FROM (SELECT r.*, array_to_string(parts[a + 1 : b], ' ') AS joined
                            FROM cut_ranges r JOIN cut_sections c ON c.paper_id = r.paper_id AND c.section_index = r.section_index)))))
            GROUP BY paper_id, section_index""",
        # Short pieces go to the passage before while it holds them.
        "cut_opens": f"""
            SELECT paper_id, section_index, 0::BIGINT AS start,
                   coalesce(list_min(list_filter(range(1, n), lambda j: counts[j + 1] >= {least} OR total[j + 2] > {size})), n) AS stop FROM cut_pieces
            UNION ALL
            SELECT o.paper_id, o.section_index, o.stop,
                   coalesce(list_min(list_filter(range(o.stop + 1, n), lambda j: counts[j + 1] >= {least} OR total[j + 2] - total[o.stop + 1] > {size})), n)
            FROM cut_opens o JOIN cut_pieces c ON c.paper_id = o.paper_id AND c.section_index = o.section_index AND o.stop < n""",
        # A short first passage opens the second one if both fit.
        "cut_passages": f"""
            SELECT paper_id, section_index, start, array_to_string(pieces[CASE WHEN m AND start > 0 THEN 1 ELSE start + 1 END : stop], ' ') AS content
            FROM (SELECT o.*, pieces, nth = 2 AND second AS m, nth = 1 AND second AS gone FROM (
                    SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY paper_id, section_index) > 1
                              AND min(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) IS NOT NULL
                              AND first_value(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) < {least}
                              AND nth_value(e, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <= {size} AS second
                    FROM (SELECT o.*, total[stop + 1] - total[start + 1] AS k, total[stop + 1] AS e
                          FROM cut_opens o JOIN cut_pieces c ON c.paper_id = o.paper_id AND c.section_index = o.section_index)
                    WINDOW w AS (PARTITION BY paper_id, section_index ORDER BY start)) o
                  JOIN cut_pieces c ON c.paper_id = o.paper_id AND c.section_index = o.section_index)
            WHERE NOT gone""",
        "passages": f"""
            SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY section_index, start) - 1 AS chunk_index, section_type, content,
                   len(regexp_split_to_array(content, '\\s+')) AS token_count
            FROM (SELECT paper_id, section_index, section_type, 0 AS start, content FROM cut_body WHERE tokens <= {size}
                  UNION ALL
                  SELECT c.paper_id, c.section_index, section_type, start, c.content
                  FROM cut_passages c JOIN cut_body b ON b.paper_id = c.paper_id AND b.section_index = c.section_index)""",
    }
