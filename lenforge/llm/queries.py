"""The training-data queries and their SQL, by name."""

from lenforge.llm import abuse, encoding, mixing, neardup, packing, pairs, percentiles, splitting

QUERIES = {
    "p1_found": pairs.p1_found,
    "p2_percentiles": percentiles.p2_percentiles,
    "p2_days_combined": percentiles.p2_days_combined,
    "p2_files_combined": percentiles.p2_files_combined,
    "p3_found": splitting.p3_found,
    "p3_pieces": splitting.p3_pieces,
    "p3_coverage": splitting.p3_coverage,
    "p4_found": neardup.p4_found,
    "p4_groups": neardup.p4_groups,
    "p4_pairs": neardup.p4_pairs,
    "p4_members": neardup.p4_members,
    "p5_packing": packing.p5_packing,
    "p5_waste": packing.p5_waste,
    "p5_whole": packing.p5_whole,
    "p6_ids": encoding.p6_ids,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p7_kept": mixing.p7_kept,
    "p8_found": abuse.p8_found,
    "p8_scores": abuse.p8_scores,
    "p8_rates": abuse.p8_rates,
}
ORACLES = {**percentiles.ORACLES, **splitting.ORACLES, **packing.ORACLES, **mixing.ORACLES, **neardup.ORACLES, **abuse.ORACLES}
