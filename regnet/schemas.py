"""Schemas of the relations, as DDL."""

GTF = "seqname string, source string, feature string, start_pos bigint, end_pos bigint, score string, strand string, frame string, attributes string"
BED = ("chrom string", "start_pos bigint", "end_pos bigint", "strand string")
NARROW_PEAK = "chrom string, start_pos bigint, end_pos bigint, name string, score int, strand string, signal_value double, p_value double, q_value double, peak int"
MOTIF = "motif_id string, motif_name string, alphabet array<string>, pwm array<array<double>>, counts array<array<double>>, background array<double>, url string, accession string, species array<string>, ln_odds double"
HIT = "motif_id string, seqname string, start_pos bigint, stop_pos bigint, strand string, p_value double, odds double, matched string"
COUNT = "gene string, count bigint"
ABUNDANCE = "transcript string, length double, eff_length double, est_counts double, tpm double"
T2G = "transcript string, gene string"
TF_INFO_KEYS = ("Motif_ID", "Motif_Name")
FIMO = "motif_id string, motif_alt_id string, sequence_name string, start bigint, stop bigint, strand string, score double, p_value double, q_value double, matched_sequence string"
HOMER_FIND = "sequence_id string, offset bigint, matched string, motif_id string, strand string, odds double"
EDGE = "regulator string, target string, n_sites bigint, score double, motif_ic double, start_pos bigint, stop_pos bigint, chromosome string"
