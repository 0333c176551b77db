"""The subpackage's queries and their SQL."""

from placelark.llm import decontamination, html_extract, license_scan, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, tool_calls

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_shard": sharding.op2_shard,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontamination.op5_decontaminate,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_tool_calls": tool_calls.op8_tool_calls,
    "op9_quality": quality_rules.op9_quality,
    "op10_mix": mixing.op10_mix,
}
SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op9_quality": quality_rules.SQL,
}
