"""Queries of this subpackage and their SQL."""
from rostrum.llm import bpe, html, lexical, licenses, mixing, neardup, neighbours, pieces, pii, quality, repeats, resampling, urls


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_html_text": html.op4_html_text,
        "op5_url_filter": urls.op5_url_filter,
        "op6_repeated_passages": repeats.op6_repeated_passages,
        "op7_near_dups": neardup.op7_near_dups,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_nearest": neighbours.op9_nearest,
        "op10_pii": pii.op10_pii,
        "op11_ranked_search": lexical.op11_ranked_search,
        "op12_importance_draw": resampling.op12_importance_draw,
        "op13_sentencepiece": pieces.op13_sentencepiece,
        "source_mix_overlap": mixing.source_mix_overlap,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op3_license_scan": licenses.OP3_SQL,
        "op5_url_filter": urls.OP5_SQL,
        "op7_near_dups": neardup.OP7_SQL,
        "op11_ranked_search": lexical.OP11_SQL,
        "op12_importance_draw": resampling.OP12_SQL,
    }
