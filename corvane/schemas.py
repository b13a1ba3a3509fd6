"""Explicit schemas of the engine's records. Map keys are data here, so inference would make structs of them."""

COUNTS = "map<string,bigint>"
NESTED = "map<string,map<string,bigint>>"
TRIPLET = "struct<h:string,r:string,t:string>"

PAPER_PAIR = f"""mesh string, gene string, pmid string, mesh_gpt_name string, gene_gpt_name string,
variant_gpt_name_list array<string>, title string, abstract string, mesh_name_to_stats map<string,array<bigint>>,
gene_name_to_stats map<string,array<bigint>>, vid_name_count {NESTED}, name_vid_count {NESTED}"""

MODEL_OUTPUT = """dgp_id bigint, mesh string, gene string, pmid string, head string, tail string,
text_out_list array<string>, request_start_time string, request_end_time string, in_tokens bigint, out_tokens bigint"""

EXTRACTION = f"struct<h:string,r:string,t:string,m:{COUNTS},g:{COUNTS},v:{NESTED}>"

COMBINED = f"""dgp_id bigint, mesh string, gene string, pmid string, mesh_name_to_matches {COUNTS},
gene_name_to_matches {COUNTS}, vid_name_matches {NESTED}, extractions array<{EXTRACTION}>"""

DIRECT_ASK = "disease string, gene string, disease_name string, gene_name string"
DIRECT_ANSWER = f"""{DIRECT_ASK}, dgp_id bigint, text_in string, text_out_list array<string>,
request_start_time string, request_end_time string, in_tokens bigint, out_tokens bigint"""

EMBEDDING_META = "id bigint, text string, tokens bigint, runs bigint, request_start_time string, request_end_time string"
TOKEN_STATS = "token string, gold_score_ratio string, gold_score bigint, score bigint, gold_dgs bigint, dgs bigint"
TWO_COLUMNS = "token string, value string"
