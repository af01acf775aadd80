"""Pieces of the checking SQL. They restate the rules on their own and share no code with the Spark side but the
fixed values."""

from __future__ import annotations

from storyloom.functions.text import BLANK_CHARS, BLANK_CLASS


def sent(text: str) -> str:
    return f"[trim(x, '{BLANK_CHARS}') || '.' for x in string_split({text}, '.') if trim(x, '{BLANK_CHARS}') <> '']"


def toks(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def words(text: str) -> str:
    return f"[x for x in regexp_split_to_array({text}, '{BLANK_CLASS}+') if x <> '']"


def flat(ids: str) -> str:
    return f"array_to_string(({ids})::VARCHAR[], ' ')"


def unit(*parts: str) -> str:
    joined = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


def ids_of(source: str, column: str) -> str:
    """doc_id and the id list of a token-list column, empty lists kept."""
    return f"""
      SELECT b.doc_id, coalesce(e.ids, []::BIGINT[]) AS ids FROM {source} b LEFT JOIN (
        SELECT doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
        FROM (SELECT doc_id, unnest({column}) AS token, generate_subscripts({column}, 1) AS pos FROM {source}) t
        LEFT JOIN vocab v ON v.token = t.token GROUP BY doc_id) e ON e.doc_id = b.doc_id"""


CTES: dict[str, str] = {
    "docs": "SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "cut": f"SELECT doc_id, text, split, {sent('text')} AS s FROM docs",
    "seg": """SELECT doc_id, text, s[1] AS first_sentence, s[-1] AS last_sentence,
        array_to_string(s[2:-2], ' ') AS middle_part FROM cut WHERE len(s) >= 3""",
    "seg2": "SELECT doc_id, text, s[1] AS first_sentence, s[-1] AS last_sentence FROM cut WHERE len(s) >= 2",
    "lists": f"SELECT doc_id, split, {toks('text')} AS t FROM docs",
    "tok": "SELECT doc_id, split, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM lists",
    "learned": """SELECT token, count(*) AS freq, min(doc_id::HUGEINT * 10000000000 + pos) AS place
        FROM tok WHERE split = 'train' GROUP BY token""",
    "vocab": """SELECT token, (3 + row_number() OVER (ORDER BY freq DESC, place))::BIGINT AS id, freq FROM learned
        UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<bos>', 2, 0), ('<eos>', 3, 0)) s(token, id, freq)""",
    "nv": "SELECT count(*) AS v FROM vocab",
    "enc": ids_of("lists", "t"),
    "framed": "SELECT doc_id, [2::BIGINT] || ids || [3::BIGINT] AS ids FROM enc",
    "seqs": "SELECT doc_id, ids[1:50] AS ids FROM framed",
    "pieces": f"""SELECT doc_id, {toks('first_sentence')} AS f, {toks('last_sentence')} AS l, {toks('middle_part')} AS m,
        {toks('text')} AS t FROM seg""",
    "pf": ids_of("pieces", "f"),
    "pl": ids_of("pieces", "l"),
    "pm": ids_of("pieces", "m"),
    "pt": ids_of("pieces", "t"),
    "prompts": """SELECT pf.doc_id, (pf.ids || [(SELECT v FROM nv)::BIGINT] || pl.ids)[1:512] AS ids
        FROM pf JOIN pl USING (doc_id)""",
    "pieces2": f"""SELECT doc_id, {toks('first_sentence')} AS f, {toks('last_sentence')} AS l, {toks('text')} AS t FROM seg2""",
    "qf": ids_of("pieces2", "f"),
    "ql": ids_of("pieces2", "l"),
    "qt": ids_of("pieces2", "t"),
    "sides": """SELECT qf.doc_id, qf.ids[1:512] AS first, ql.ids[1:512] AS last, qt.ids[1:512] AS truth
        FROM qf JOIN ql USING (doc_id) JOIN qt USING (doc_id)""",
    "mids": """SELECT doc_id, first, last, truth,
        CASE WHEN len(truth) - len(first) - len(last) > 0 THEN truth[len(first) + 1:len(truth) - len(last)]
             ELSE truth[len(first) + 1:] END AS middle FROM sides""",
    # Pairs of every story's framed ids; the model is counted on train only.
    "pairs": """SELECT doc_id, doc_id % 10 = 0 AS held, unnest(ids[1:len(ids) - 1]) AS context, unnest(ids[2:]) AS target,
        generate_subscripts(ids[2:], 1) AS pos FROM framed""",
    "counts": "SELECT context, target, count(*) AS freq FROM pairs WHERE NOT held GROUP BY context, target",
    "ctx": """SELECT context, sum(freq)::BIGINT AS total, count(*) AS seen, sum(ln(freq + 1)) AS log_sum
        FROM counts GROUP BY context""",
    "seq_pairs": """SELECT doc_id, unnest(ids[1:len(ids) - 1]) AS context, unnest(ids[2:]) AS target FROM framed""",
    "doc_loss": """SELECT p.doc_id, count(*) AS n,
        sum(-ln((coalesce(c.freq, 0) + 1) / (coalesce(x.total, 0) + (SELECT v FROM nv))::DOUBLE)) AS nll
        FROM seq_pairs p LEFT JOIN counts c ON c.context = p.context AND c.target = p.target
        LEFT JOIN ctx x ON x.context = p.context GROUP BY p.doc_id""",
    "numbered": "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch_id FROM framed",
    "scores": "SELECT context, target AS token, freq, ln(freq) AS score FROM counts",
}

NEEDS: dict[str, list[str]] = {
    "cut": ["docs"], "seg": ["cut"], "seg2": ["cut"], "lists": ["docs"], "tok": ["lists"], "learned": ["tok"],
    "vocab": ["learned"], "nv": ["vocab"], "enc": ["lists", "vocab"], "framed": ["enc"], "seqs": ["framed"],
    "pieces": ["seg"], "pf": ["pieces", "vocab"], "pl": ["pieces", "vocab"], "pm": ["pieces", "vocab"],
    "pt": ["pieces", "vocab"], "prompts": ["pf", "pl", "nv"], "pieces2": ["seg2"], "qf": ["pieces2", "vocab"],
    "ql": ["pieces2", "vocab"], "qt": ["pieces2", "vocab"], "sides": ["qf", "ql", "qt"], "mids": ["sides"],
    "pairs": ["framed"], "counts": ["pairs"], "ctx": ["counts"], "seq_pairs": ["framed"],
    "doc_loss": ["seq_pairs", "counts", "ctx", "nv"], "numbered": ["framed"], "scores": ["counts"],
}


def sql(*needs: str, body: str, extra: dict[str, str] | None = None) -> str:
    """A query over the named pieces and what they need, each materialised once."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    # A piece that reads itself is a recursion and cannot be materialised.
    again = {n for n, text in (extra or {}).items() if f"FROM {n} " in text}
    parts += [f"{n} AS ({text})" if n in again else f"{n} AS MATERIALIZED ({text})" for n, text in (extra or {}).items()]
    return (f"WITH {'RECURSIVE ' if again else ''}{', '.join(parts)} " if parts else "") + body
