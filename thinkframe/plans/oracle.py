"""SQL twins of the registered queries, written for DuckDB over the driver's
views (``conversations``, ``documents``, ``events``, ``benchmark``, ...).
They restate each operator's rule in plain SQL, independently of the Spark
code, so the driver can compare results."""

from __future__ import annotations

import unicodedata

# Fixed values
SYSTEM_PROMPT = "You are a careful, helpful assistant."
MATH_DIRECTIVE = "Please reason step by step, and put your final answer within \\boxed{}."
GPQA_DIRECTIVE = ("Think step by step, then give your final answer as a single "
                  "letter (A, B, C, or D) within \\boxed{}, e.g. \\boxed{A}.")
LATEX_REMOVALS = ["\\left", "\\right", "\\!", "\\,", "\\;", "\\text{}"]
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
          8201, 8202, 8232, 8233, 8239, 8287, 12288]

DIGITS = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
WS_SQL = "(" + "||".join(f"chr({c})" for c in SPACES) + ")"
WS_REGEX_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in SPACES) + "]"
NL = "chr(10)"
O_QWEN = f"('<think>'||{NL})"
C_QWEN = f"({NL}||'</think>'||{NL}||{NL})"
O_GEMMA = f"('<|channel>thought'||{NL})"
C_GEMMA = "'<channel|>'"
PY_FLOAT = r"^[+-]?((\d(_?\d)*)?\.\d(_?\d)*|\d(_?\d)*\.?)([eE][+-]?\d(_?\d)*)?$"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def sqlstr(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r9(x: str) -> str:
    return f"round(cast({x} as double), 9)"


# ------------------------------------------------------------------ fixtures
F1 = f"""f1 AS (
 SELECT cast(a.conv_id*100+a.turn as bigint) AS ex_id, u.text AS prompt,
  chr(9)||chr(160)||substr(a.text,1,length(a.text)-length(split_part(a.text,{NL},-1))) AS thinking,
  split_part(a.text,{NL},-1)||{NL} AS answer
 FROM conversations a JOIN conversations u ON u.conv_id=a.conv_id AND u.turn=a.turn-1
 WHERE a.role='assistant' AND u.role='user')"""

F2 = r"""f2 AS (
 SELECT doc_id AS question_id, lang, cast((doc_id*doc_id)%7 as varchar) AS reference,
  substr('ABCD',cast(doc_id%3 as int)+1,1) AS ref_letter,
  '<think>'||chr(10)||text||CASE WHEN doc_id%9=7 THEN '' ELSE chr(10)||'</think>'||chr(10)||chr(10) END||'The answer is '||
  CASE doc_id%9
   WHEN 0 THEN chr(92)||'boxed{'||cast(doc_id%7 as varchar)||'}'
   WHEN 1 THEN chr(92)||'boxed{'||chr(92)||'text{'||cast(doc_id%7 as varchar)||'}}'
   WHEN 2 THEN chr(92)||'boxed{ '||cast(doc_id%7 as varchar)||'.0 }'
   WHEN 3 THEN chr(92)||'boxed{{'||cast(doc_id%7 as varchar)||'}}'
   WHEN 4 THEN chr(92)||'boxed{1} or '||chr(92)||'boxed{$'||cast(doc_id%7 as varchar)||'$}'
   WHEN 5 THEN chr(92)||'boxed{'||cast(doc_id%7 as varchar)
   WHEN 6 THEN 'option '||substr('ABCD',cast(doc_id%5%4 as int)+1,1)
   WHEN 7 THEN chr(92)||'boxed{'||cast(doc_id%7 as varchar)||'}'
   ELSE chr(92)||'boxed{('||substr('ABCD',cast(doc_id%5%4 as int)+1,1)||')}' END AS response
 FROM documents)"""

F3 = """f3 AS (
 SELECT c.conv_id AS question_id, cast(r.rep as int) AS "repeat", cast(c.rnd as int) AS "round", c.text,
  cast(10+c.conv_id%20 as bigint) AS prompt_tokens, cast(length(c.text) as bigint) AS output_tokens,
  CASE WHEN c.rnd<c.mx THEN 'length' WHEN (length(c.text)+r.rep)%4=0 THEN 'length' ELSE 'stop' END AS finish_reason
 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS rnd,
              count(*) OVER (PARTITION BY conv_id)-1 AS mx FROM conversations WHERE role='assistant') c
 CROSS JOIN (SELECT 0 AS rep UNION ALL SELECT 1 UNION ALL SELECT 2) r)"""

RQ = """rq AS (
 SELECT conv_id AS question_id, arg_min(text, turn) AS question, cast(conv_id%7 as varchar) AS reference
 FROM conversations WHERE role='user' GROUP BY conv_id)"""

F4 = """f4 AS (
 SELECT CASE lang WHEN 'en' THEN 's1k11_all_qwen3' WHEN 'de' THEN 's1k11_correct_only_qwen3'
         WHEN 'fr' THEN 's1k11_all_dsr1_llama8b' ELSE 'base_qwen3' END AS dataset_name,
  CASE WHEN lang NOT IN ('en','de','fr') THEN 'base' WHEN doc_id%2=0 THEN 'cotgen' ELSE 'cotcond' END AS mode,
  CASE doc_id%4 WHEN 0 THEN 'aime24' WHEN 1 THEN 'aime25' WHEN 2 THEN 'math500' ELSE 'gpqa_diamond' END AS benchmark,
  'run'||cast(1+doc_id%3 as varchar) AS run_id, r.rep AS "repeat", doc_id AS question_id,
  (doc_id*7+r.rep*3)%4<>0 AS is_correct, (doc_id+r.rep)%5=0 AS was_truncated, (doc_id+r.rep)%15=0 AS still_truncated,
  cast(10+doc_id%20 as bigint) AS prompt_tokens, n_chars AS output_tokens,
  cast(floor(n_chars/5) as bigint) AS reasoning_tokens, cast(floor(n_chars/9) as bigint) AS initial_reasoning_tokens,
  cast(10+r.rep as double) AS elapsed_seconds
 FROM documents CROSS JOIN (SELECT 0 AS rep UNION ALL SELECT 1 UNION ALL SELECT 2) r
 WHERE NOT (doc_id%3=2 AND r.rep=2))"""

KEYS = 'dataset_name, mode, benchmark, run_id'

T4_F4 = """t4 AS (SELECT *, CASE WHEN was_truncated THEN greatest(0, reasoning_tokens-initial_reasoning_tokens) END
              AS reasoning_tokens_added FROM f4)"""

G2_BODY = f"""g2 AS (
 SELECT {KEYS}, "repeat",
  count(*) AS num_questions,
  count(*) FILTER (WHERE is_correct) AS num_correct,
  count(*) FILTER (WHERE is_correct AND NOT was_truncated) AS num_correct_excl_extended,
  count(*) FILTER (WHERE was_truncated) AS num_extended,
  count(*) FILTER (WHERE was_truncated AND is_correct) AS num_extended_correct,
  count(*) FILTER (WHERE was_truncated AND NOT is_correct) AS num_extended_incorrect,
  count(*) FILTER (WHERE was_truncated AND still_truncated) AS num_still_truncated,
  cast(sum(prompt_tokens) as bigint) AS total_prompt_tokens,
  cast(sum(output_tokens) as bigint) AS total_output_tokens,
  max(elapsed_seconds) AS elapsed_seconds,
  coalesce(avg(reasoning_tokens), 0) AS mean_reasoning_tokens,
  coalesce(median(reasoning_tokens), 0) AS median_reasoning_tokens,
  coalesce(avg(CASE WHEN was_truncated THEN reasoning_tokens_added END), 0) AS mean_extended_reasoning_tokens_added,
  coalesce(median(CASE WHEN was_truncated THEN reasoning_tokens_added END), 0) AS median_extended_reasoning_tokens_added
 FROM t4 GROUP BY {KEYS}, "repeat"),
 pr AS (
 SELECT {KEYS}, "repeat",
  num_correct/num_questions AS accuracy, num_correct_excl_extended/num_questions AS accuracy_excl_extended,
  num_correct, num_correct_excl_extended, num_extended, num_extended_correct, num_extended_incorrect,
  CASE WHEN num_extended>0 THEN num_extended_correct/num_extended END AS extended_accuracy,
  num_still_truncated, num_questions, elapsed_seconds, total_prompt_tokens, total_output_tokens,
  CASE WHEN elapsed_seconds<>0 THEN total_prompt_tokens/elapsed_seconds END AS input_tokens_per_sec,
  CASE WHEN elapsed_seconds<>0 THEN total_output_tokens/elapsed_seconds END AS output_tokens_per_sec,
  CASE WHEN elapsed_seconds<>0 THEN num_questions/elapsed_seconds END AS queries_per_sec,
  mean_reasoning_tokens, median_reasoning_tokens, mean_extended_reasoning_tokens_added,
  median_extended_reasoning_tokens_added
 FROM g2)"""

G2 = T4_F4 + ",\n " + G2_BODY

SUMMARY_COLS = f"""{KEYS},
  count(*) AS num_repeats_completed, count(*)>=3 AS is_complete, max(num_questions) AS num_questions,
  sum(elapsed_seconds) AS total_wall_clock_seconds,
  avg(accuracy) AS accuracy_mean, coalesce(stddev_samp(accuracy),0) AS accuracy_std,
  avg(accuracy_excl_extended) AS accuracy_mean_excl_extended,
  coalesce(stddev_samp(accuracy_excl_extended),0) AS accuracy_std_excl_extended,
  cast(sum(num_extended) as bigint) AS num_extended_total,
  cast(sum(num_extended_correct) as bigint) AS num_extended_correct_total,
  cast(sum(num_extended_incorrect) as bigint) AS num_extended_incorrect_total,
  avg(extended_accuracy) AS extended_accuracy_mean,
  cast(sum(num_still_truncated) as bigint) AS num_still_truncated_total,
  avg(mean_extended_reasoning_tokens_added) AS mean_extended_reasoning_tokens_added_mean,
  avg(output_tokens_per_sec) AS output_tokens_per_sec_mean, avg(input_tokens_per_sec) AS input_tokens_per_sec_mean,
  avg(queries_per_sec) AS queries_per_sec_mean, avg(mean_reasoning_tokens) AS mean_reasoning_tokens_mean"""

RUNS = f"""runs AS (SELECT {SUMMARY_COLS}, cast(3 as bigint) AS num_repeats,
  string_agg(cast("repeat" as varchar), ',' ORDER BY "repeat") AS repeats FROM pr GROUP BY {KEYS})"""

MODEL = ("CASE WHEN starts_with(dataset_name,'base_') THEN substr(dataset_name,6) "
         "WHEN starts_with(dataset_name,'s1k11_correct_only_') THEN substr(dataset_name,20) "
         "WHEN starts_with(dataset_name,'s1k11_all_') THEN substr(dataset_name,11) END")
ABLATION = ("CASE WHEN starts_with(dataset_name,'base_') THEN 'base' "
            "WHEN starts_with(dataset_name,'s1k11_correct_only_') THEN 'correct_only' "
            "WHEN starts_with(dataset_name,'s1k11_all_') THEN 'all' END")

F5 = f"""f5 AS (
 SELECT *, {MODEL} AS model_family,
  CASE WHEN mode='base' AND run_id='run3' THEN 'ckpt/base' WHEN mode='base' THEN NULL
       WHEN mode='cotcond' AND benchmark='aime25' AND run_id='run2' THEN NULL ELSE 'ckpt/'||run_id END AS checkpoint_dir,
  CASE WHEN run_id='run2' THEN 0.7::double END AS temperature,
  CASE WHEN run_id='run3' AND benchmark='gpqa_diamond' THEN 0.9::double END AS top_p,
  dataset_name||'_'||mode||'_'||benchmark||'_'||run_id||'_summary.json' AS file_name,
  'eval_results/'||dataset_name||'_'||mode||'_'||benchmark||'_'||run_id||'_summary.json' AS source_path
 FROM runs)"""

F6 = """f6 AS (
 SELECT CASE user_id%3 WHEN 0 THEN 's1k11_all_qwen3' WHEN 1 THEN 's1k11_correct_only_qwen3' ELSE 's1k11_all_gone' END AS dataset_name,
  CASE WHEN user_id%2=0 THEN 'cotgen' ELSE 'cotcond' END AS mode, user_id%4 AS attempt,
  min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS num_input_tokens_seen,
  cast(CASE WHEN user_id%4=3 THEN 0 ELSE count(DISTINCT event_type) END as double) AS train_runtime,
  cast(sum(event_id) as double) AS total_flos, min(value) AS train_loss, max(value) AS peak_mem,
  CASE WHEN user_id%4=2 THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN user_id%4<2 THEN '0' ELSE '0,1' END AS gpu_ids
 FROM events GROUP BY user_id%3, user_id%2, user_id%4),
 ts6 AS (
 SELECT dataset_name, mode, CASE WHEN exit_code=0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, gpu_ids,
  cast(len(string_split(gpu_ids, ',')) as bigint) AS num_gpus,
  strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') AS start_time, strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ') AS end_time,
  cast(floor((epoch_us(end_ts)-epoch_us(start_ts))/1000000) as bigint) AS wall_clock_seconds,
  CASE WHEN peak_mem>0 THEN peak_mem END AS peak_gpu_memory_mib_total,
  CASE WHEN exit_code=0 THEN train_runtime END AS train_runtime,
  CAST(NULL AS double) AS train_samples_per_second, CAST(NULL AS double) AS train_steps_per_second,
  CASE WHEN exit_code=0 THEN train_loss END AS train_loss, CASE WHEN exit_code=0 THEN total_flos END AS total_flos,
  CAST(NULL AS double) AS eval_loss,
  CASE WHEN exit_code=0 THEN num_input_tokens_seen END AS num_input_tokens_seen,
  'ckpt/'||dataset_name||'_'||mode AS output_dir, 'configs/'||dataset_name||'_'||mode||'.yaml' AS config,
  'results/attempt'||cast(attempt as varchar)||'/'||dataset_name||'_'||mode||'_summary.json' AS source_path
 FROM f6)"""

F7 = """f7 AS (SELECT 'run'||cast(user_id%10 as varchar) AS run_id, event_type AS gpu,
 date_trunc('hour', ts) AS sample_ts, value AS mem FROM events)"""

F8 = """f8 AS (SELECT doc_id AS pos, 'rec'||cast(doc_id as varchar) AS id, text AS question,
 'right-'||cast(doc_id as varchar) AS o0, 'wrong1-'||cast(doc_id as varchar) AS o1,
 'wrong2-'||cast(doc_id as varchar) AS o2, 'wrong3-'||cast(doc_id as varchar) AS o3 FROM documents)"""

GPQA = """gp AS (
 SELECT pos, id, question, o0, o1, o2, o3,
  1+(k1<k0)::int+(k2<k0)::int+(k3<k0)::int AS r0, 1+(k0<k1)::int+(k2<k1)::int+(k3<k1)::int AS r1,
  1+(k0<k2)::int+(k1<k2)::int+(k3<k2)::int AS r2, 1+(k0<k3)::int+(k1<k3)::int+(k2<k3)::int AS r3
 FROM (SELECT *, md5('gpqa-'||cast(pos as varchar)||'-0') AS k0, md5('gpqa-'||cast(pos as varchar)||'-1') AS k1,
              md5('gpqa-'||cast(pos as varchar)||'-2') AS k2, md5('gpqa-'||cast(pos as varchar)||'-3') AS k3 FROM f8)),
 gq AS (
 SELECT pos, id, question, substr('ABCD', r0, 1) AS reference,
  CASE 1 WHEN r0 THEN o0 WHEN r1 THEN o1 WHEN r2 THEN o2 ELSE o3 END AS choice_a,
  CASE 2 WHEN r0 THEN o0 WHEN r1 THEN o1 WHEN r2 THEN o2 ELSE o3 END AS choice_b,
  CASE 3 WHEN r0 THEN o0 WHEN r1 THEN o1 WHEN r2 THEN o2 ELSE o3 END AS choice_c,
  CASE 4 WHEN r0 THEN o0 WHEN r1 THEN o1 WHEN r2 THEN o2 ELSE o3 END AS choice_d
 FROM gp)"""

BENCH = """bu AS (
 SELECT 'aime24' AS benchmark, cast(item_id as bigint) AS pos, 'bench-'||cast(item_id as varchar) AS id,
        text AS question, cast(length(text) as varchar) AS reference FROM benchmark
 UNION ALL SELECT 'aime25', doc_id, cast(doc_id as varchar), text, cast(n_chars as varchar) FROM documents
 UNION ALL SELECT 'math500', doc_id, source||'/'||lang||'/'||cast(doc_id as varchar), text, lang FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------- reusable column rules
def split_cte(name: str, src: str, prefix_sql: str, text: str, keep: str = "*") -> str:
    """A1 as a chain of derived columns: _full, _o, _cr -> thinking, answer."""
    return f"""{name} AS (
 SELECT {keep}, CASE WHEN _o>0 AND _cr>0 THEN {strip('substr(_full, _o+7, _cr-1)')} ELSE '' END AS thinking,
  CASE WHEN _o>0 AND _cr>0 THEN {strip('substr(_full, _o+7+_cr-1+8)')} ELSE {strip('_full')} END AS answer
 FROM (SELECT *, CASE WHEN _o>0 THEN instr(substr(_full, _o+7), '</think>') ELSE 0 END AS _cr
       FROM (SELECT *, instr(_full, '<think>') AS _o FROM (SELECT *, {prefix_sql}||{text} AS _full FROM {src}))))"""


def boxed_cte(name: str, src: str, text: str) -> str:
    """A2: brace-balanced content of the last \\boxed{ (NULL if none or unbalanced)."""
    return f"""{name} AS (
 SELECT *, CASE WHEN instr({text}, chr(92)||'boxed{{')>0 AND coalesce(_k,0)>0
                THEN array_to_string(_segs[1:_k], '}}') END AS boxed
 FROM (SELECT *, list_position(list_transform(range(1, len(_segs)),
          lambda k: 1 + length(array_to_string(_segs[1:k], '')) - length(replace(array_to_string(_segs[1:k], ''), '{{', '')) - k), 0) AS _k
       FROM (SELECT *, string_split(string_split({text}, chr(92)||'boxed{{')[-1], '}}') AS _segs FROM {src})))"""


def normalize(x: str) -> str:
    """A3 as one nested expression."""
    s = strip(x)
    for tok in LATEX_REMOVALS:
        s = f"replace({s}, {sqlstr(tok)}, '')"
    s = f"regexp_replace({s}, '\\\\text\\{{([^}}]*)\\}}', '\\1', 'g')"
    s = f"replace({s}, ' ', '')"
    s = f"rtrim({s}, '.')"
    s = f"trim({s}, '$')"
    return s


def norm_cte(name: str, src: str, pred: str, ref: str) -> str:
    return f"""{name} AS (
 SELECT *, CASE WHEN starts_with(_np0,'{{') AND ends_with(_np0,'}}') THEN (CASE WHEN length(_np0)>=2 THEN substr(_np0,2,length(_np0)-2) ELSE '' END) ELSE _np0 END AS _np,
  CASE WHEN starts_with(_nr0,'{{') AND ends_with(_nr0,'}}') THEN (CASE WHEN length(_nr0)>=2 THEN substr(_nr0,2,length(_nr0)-2) ELSE '' END) ELSE _nr0 END AS _nr
 FROM (SELECT *, {normalize(pred)} AS _np0, {normalize(ref)} AS _nr0 FROM {src}))"""


def pyfloat(x: str) -> str:
    t = f"translate({strip(x)}, {sqlstr(''.join(DIGITS))}, {sqlstr(''.join(str(unicodedata.decimal(d)) for d in DIGITS))})"
    return f"CASE WHEN regexp_matches({t}, {sqlstr(PY_FLOAT)}) THEN try_cast(replace({t}, '_', '') AS double) END"


def math_correct(boxed: str = "boxed") -> str:
    return (f"CASE WHEN {boxed} IS NULL THEN false ELSE coalesce(_np = _nr, false) OR "
            f"coalesce(abs(({pyfloat('_np')}) - ({pyfloat('_nr')})) < 1e-6, false) END")


def letters(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(upper({x}), '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: w IN ('A','B','C','D'))")


def letter(text: str, boxed: str = "boxed") -> str:
    return f"coalesce(({letters(boxed)})[1], ({letters(text)})[-1])"


def words(x: str) -> str:
    return (f"CASE WHEN {strip(x)} = '' THEN 0 ELSE "
            f"len(regexp_split_to_array({strip(x)}, '{WS_REGEX_CLASS}+')) END")


# ------------------------------------------------------------------- queries
Q = {}

Q["examples_required_fields"] = with_(F1) + """
SELECT ex_id,
 concat_ws(',', CASE WHEN prompt IS NULL THEN 'prompt' END, CASE WHEN thinking IS NULL THEN 'thinking' END,
           CASE WHEN answer IS NULL THEN 'answer' END) AS missing_fields,
 (prompt IS NOT NULL AND thinking IS NOT NULL AND answer IS NOT NULL) AS is_valid
FROM (SELECT ex_id, prompt, CASE WHEN ex_id%1500>=100 THEN thinking END AS thinking,
             CASE WHEN ex_id%1000>=100 THEN answer END AS answer FROM f1)"""

Q["think_response"] = with_(F1) + f"""
SELECT ex_id, fam.model_family, fam.o||{strip('thinking')}||fam.c||{strip('answer')} AS response
FROM f1 CROSS JOIN (SELECT 'qwen3' AS model_family, {O_QWEN} AS o, {C_QWEN} AS c
                    UNION ALL SELECT 'gemma4', {O_GEMMA}, {C_GEMMA}) fam"""

SPLIT = f"""h AS (SELECT *, md5('12345:'||cast(ex_id as varchar)) AS hh FROM f1),
 nv AS (SELECT greatest(1, cast(floor(count(*)*cast(0.02 as double)) as bigint)) AS n_val FROM f1),
 sp AS (SELECT h.*, CASE WHEN row_number() OVER (ORDER BY hh, ex_id) <= (SELECT n_val FROM nv)
                    THEN 'val' ELSE 'train' END AS split FROM h),
 recs AS (SELECT ex_id, split, m.mode, 'human' AS human_from, prompt AS human_value, 'gpt' AS gpt_from,
   {O_QWEN}||{strip('thinking')}||{C_QWEN}||{strip('answer')} AS gpt_value
   FROM sp CROSS JOIN (SELECT 'cotgen' AS mode UNION ALL SELECT 'cotcond') m)"""

Q["holdout_split"] = with_(F1, SPLIT.split(",\n recs AS")[0]) + "SELECT ex_id, split FROM sp"

Q["sharegpt_records"] = with_(F1, SPLIT) + f"""
SELECT ex_id, 's1k11_all_qwen3_'||mode||'_'||split AS dataset_key, mode, split,
 {sqlstr(SYSTEM_PROMPT)} AS system, human_from, human_value, gpt_from, gpt_value FROM recs"""

Q["catalog_upsert"] = with_(F1, SPLIT) + """,
 k AS (SELECT mode, split, count(*) AS num_rows FROM recs GROUP BY mode, split),
 old AS (SELECT 's1k11_correct_only_qwen3_'||mode||'_'||split AS dataset_key, 'data/v1' AS base, num_rows FROM k
         UNION ALL SELECT 's1k11_all_qwen3_'||mode||'_'||split, 'data/v1', num_rows FROM k),
 new AS (SELECT 's1k11_all_qwen3_'||mode||'_'||split AS dataset_key, 'data/v2' AS base, num_rows FROM k),
 cat AS (SELECT * FROM old WHERE dataset_key NOT IN (SELECT dataset_key FROM new) UNION ALL SELECT * FROM new)
SELECT dataset_key, base||'/dataset_key='||dataset_key AS file_name, 'sharegpt' AS formatting,
 'conversations' AS messages_column, 'system' AS system_column, 'from' AS role_tag, 'value' AS content_tag,
 'human' AS user_tag, 'gpt' AS assistant_tag, num_rows FROM cat"""

Q["catalog_versions"] = with_(F1, SPLIT) + """,
 k AS (SELECT mode||'_'||split AS part, count(*) AS num_rows FROM recs GROUP BY mode, split),
 v(version, name, base) AS (VALUES (1, 's1k11_all_qwen3', 'data/v1'), (2, 's1k11_all_qwen3', 'data/v2'),
   (3, 's1k11_all_qwen3', 'data/v2'), (3, 's1k11_correct_only_qwen3', 'data/v1'))
SELECT cast(version AS bigint) AS version, name||'_'||part AS dataset_key, base||'/dataset_key='||name||'_'||part AS file_name,
 'sharegpt' AS formatting, 'conversations' AS messages_column, 'from' AS role_tag, num_rows FROM k, v"""

F9 = f"""f9 AS (
 SELECT ex_id, cast(v as bigint) AS variant, np,
  CASE v WHEN 0 THEN {O_QWEN}||t||{C_QWEN}||a WHEN 1 THEN {O_QWEN}||t||a WHEN 2 THEN {C_QWEN}||t||{O_QWEN}||a
         WHEN 3 THEN {O_QWEN}||t||{C_QWEN}||a||{C_QWEN}||a ELSE {O_QWEN}||{C_QWEN}||a END AS response
 FROM (SELECT ex_id, cast(ceil(length(prompt)/3.0) as bigint) AS np, {strip('thinking')} AS t, {strip('answer')} AS a, cast(floor(ex_id/100)%5 as int) AS v FROM f1)),
 m1 AS (SELECT ex_id, variant, np, cast(ceil(length(response)/3.0) as bigint) AS n,
   instr(response, {O_QWEN})-1 AS o,
   CASE WHEN instr(response, {C_QWEN})>0 THEN length(response)-11-instr(reverse(response), reverse({C_QWEN}))+1 ELSE -1 END AS c
   FROM f9),
 m2 AS (SELECT *, least(n, greatest(1, cast(ceil((o+8)/3.0) as bigint))) AS cs,
                  least(n, greatest(1, cast(ceil(c/3.0) as bigint))) AS ce FROM m1),
 m3 AS (SELECT *, CASE WHEN o<0 THEN 'no_open_tag' WHEN c<0 THEN 'no_close_tag' WHEN c<=o THEN 'close_before_open'
                       WHEN ce<=cs THEN 'empty_span' ELSE 'masked' END AS mask_status FROM m2)"""

F10 = (F9.replace("f9 AS", "f10 AS").replace("FROM f9)", "FROM f10)").replace("ceil(length(prompt)/3.0)", "ceil(strlen(prompt)/3.0)")
       .replace("cast(ceil(length(response)/3.0) as bigint) AS n,", "cast(ceil(strlen(response)/3.0) as bigint) AS n, response,")
       .replace("ceil((o+8)/3.0)", "ceil((strlen(response[:o+7])+1)/3.0)").replace("ceil(c/3.0)", "ceil((strlen(response[:c-1])+1)/3.0)"))

Q["think_mask"] = with_(F1, F9) + """
SELECT ex_id, variant, mask_status,
 CASE WHEN mask_status='masked' THEN np+cs END AS mask_start, CASE WHEN mask_status='masked' THEN np+ce END AS mask_end,
 np+n AS n_tokens, np+CASE WHEN mask_status='masked' THEN ce-cs ELSE 0 END AS n_ignored,
 md5(array_to_string(list_transform(range(np+n), lambda i: CASE WHEN i<np THEN -100
      WHEN mask_status='masked' AND i>=np+cs AND i<np+ce THEN -100 ELSE i END), ',')) AS labels_md5
FROM m3"""

Q["think_mask_bytes"] = Q["think_mask"].replace(F9, F10)
Q["mask_fail_open_audit"] = with_(F1, F9) + """
SELECT variant, mask_status, count(*) AS n_rows,
 cast(sum(CASE WHEN mask_status='masked' THEN ce-cs ELSE 0 END) as bigint) AS n_masked_tokens
FROM m3 GROUP BY variant, mask_status"""

Q["benchmark_union"] = with_(BENCH) + "SELECT benchmark, pos, id, question, reference, true AS no_choices FROM bu"

Q["choice_permutation"] = with_(F8, GPQA) + "SELECT pos, id, reference, choice_a, choice_b, choice_c, choice_d FROM gq"

Q["format_questions"] = with_(BENCH, F8, GPQA) + f"""
SELECT benchmark, pos, id, 'user' AS role, {strip('question')}||{NL}||{NL}||{sqlstr(MATH_DIRECTIVE)} AS prompt_text FROM bu
UNION ALL
SELECT 'gpqa_diamond', pos, id, 'user',
 {strip('question')}||{NL}||{NL}||'A) '||choice_a||{NL}||'B) '||choice_b||{NL}||'C) '||choice_c||{NL}||'D) '||choice_d
 ||{NL}||{NL}||{sqlstr(GPQA_DIRECTIVE)} FROM gq"""


def fold_sql(src: str, maxr: str, keys: str = '"repeat", question_id', extra_any: str = "") -> str:
    return f"""fr AS (SELECT * FROM {src} WHERE "round" <= {maxr}),
 fs AS (SELECT *, min(CASE WHEN finish_reason<>'length' THEN "round" END) OVER (PARTITION BY {keys}) AS _stop FROM fr),
 fk AS (SELECT * FROM fs WHERE _stop IS NULL OR "round" <= _stop),
 fold AS (SELECT {keys}{extra_any},
  string_agg(text, '' ORDER BY "round") AS text,
  max(CASE WHEN "round"=0 THEN text END) AS initial_round_text,
  max(CASE WHEN "round"=0 THEN prompt_tokens END) AS prompt_tokens,
  cast(sum(output_tokens) as bigint) AS output_tokens,
  max(CASE WHEN "round"=0 THEN output_tokens END) AS initial_round_output_tokens,
  cast(sum(output_tokens) as bigint)-max(CASE WHEN "round"=0 THEN output_tokens END) AS continuation_output_tokens,
  max(CASE WHEN "round"=0 THEN finish_reason END)='length' AS was_truncated,
  arg_max(finish_reason, "round")='length' AS still_truncated,
  count(*) AS num_rounds, cast(max("round") as bigint) AS last_round
 FROM fk GROUP BY {keys} HAVING min("round")=0)"""


Q["generation_requests"] = with_(BENCH, f"""gq0 AS (SELECT benchmark, pos, id,
  {strip('question')}||{NL}||{NL}||{sqlstr(MATH_DIRECTIVE)} AS prompt_text FROM bu)""") + f"""
SELECT benchmark, pos, id, cast(r.rep as bigint) AS "repeat", cast({words('prompt_text')} as bigint) AS prompt_words,
 cast(least(32768, greatest(1, 40864 - {words('prompt_text')})) as bigint) AS max_tokens,
 cast(12345 + r.rep as bigint) AS seed
FROM gq0 CROSS JOIN (SELECT 0 AS rep UNION ALL SELECT 1 UNION ALL SELECT 2) r"""

Q["fold_rounds"] = with_(F3, fold_sql("f3", "2")) + """
SELECT cast("repeat" as bigint) AS "repeat", question_id, text, initial_round_text, prompt_tokens, output_tokens,
 initial_round_output_tokens, continuation_output_tokens, was_truncated, still_truncated, num_rounds, last_round FROM fold"""

FAM = """fam AS (SELECT * FROM (VALUES ('qwen3', 1, 4000, 40960), ('dsr1_llama8b', 2, NULL, 131072),
  ('dsr1_qwen7b', 2, NULL, 131072), ('qwen3_0p6b', 1, 4000, 40960), ('qwen3_4b', 1, 4000, 40960))
  t(model_family, max_rounds, cont_override, native))"""

Q["continuation_worklist"] = with_(F3, RQ, FAM, """r3 AS (
 SELECT f3.*, fam.max_rounds, fam.cont_override, fam.native FROM
 (SELECT *, ['qwen3','dsr1_llama8b','dsr1_qwen7b','qwen3_0p6b','qwen3_4b'][cast(question_id%5 as int)+1] AS model_family FROM f3) f3
 JOIN fam USING (model_family))""",
    fold_sql("r3", "max_rounds", '"repeat", question_id, model_family',
             ", any_value(max_rounds) AS max_rounds, any_value(cont_override) AS cont_override, any_value(native) AS native"),
    """wl AS (SELECT *, coalesce(cont_override, 1024) AS cont,
   least(256+1024+max_rounds*coalesce(cont_override, 1024), native) AS mml FROM fold
   WHERE still_truncated AND last_round < max_rounds)""") + """
SELECT cast("repeat" as bigint) AS "repeat", question_id, model_family, last_round+1 AS next_round,
 q.question||text AS next_prompt, prompt_tokens+output_tokens AS next_prompt_tokens, cast(mml as bigint) AS max_model_len,
 cast(least(cont, greatest(1, mml-(prompt_tokens+output_tokens))) as bigint) AS max_tokens
FROM wl LEFT JOIN rq q USING (question_id)"""

Q["split_think_answer"] = with_(F2, f"""fx AS (SELECT f2.*, fam.model_family, fam.prefix FROM f2 CROSS JOIN
  (SELECT 'qwen3' AS model_family, '' AS prefix UNION ALL SELECT 'dsr1_llama8b', {O_QWEN}) fam)""",
    split_cte("s", "fx", "prefix", "response")) + "SELECT question_id, model_family, thinking, answer FROM s"

Q["last_boxed"] = with_(F2, boxed_cte("b", "f2", "response")) + "SELECT question_id, boxed FROM b"

GRADE_MATH_CTES = [F2, split_cte("s", "f2", "''", "response"), boxed_cte("b", "s", "answer"),
                   norm_cte("nm", "b", "boxed", "reference")]

Q["grade_math"] = with_(*GRADE_MATH_CTES) + f"""
SELECT question_id, lang, reference, {math_correct()} AS is_correct, boxed AS extracted FROM nm"""

Q["grade_letter"] = with_(F2, split_cte("s", "f2", "''", "response"), boxed_cte("b", "s", "answer"),
                          "bb AS (SELECT *, CASE WHEN question_id%2=0 THEN ref_letter ELSE reference END AS dref FROM b)",
                          norm_cte("nm", "bb", "boxed", "dref")) + f"""
SELECT question_id, CASE WHEN question_id%2=0 THEN 'gpqa_diamond' ELSE 'math500' END AS benchmark, ref_letter,
 coalesce({letter('answer')} = ref_letter, false) AS letter_correct, {letter('answer')} AS letter,
 CASE WHEN question_id%2=0 THEN coalesce({letter('answer')} = ref_letter, false) ELSE {math_correct()} END AS is_correct,
 CASE WHEN question_id%2=0 THEN {letter('answer')} ELSE boxed END AS extracted
FROM nm"""

EVAL_TRACE_CTES = [F3, RQ, fold_sql("f3", "2"),
                   "fj AS (SELECT fold.*, rq.reference FROM fold JOIN rq USING (question_id))",
                   split_cte("s", "fj", O_QWEN, "text"),
                   "si AS (SELECT * RENAME (thinking AS full_thinking, answer AS full_answer) FROM s)",
                   split_cte("s2", "(SELECT * EXCLUDE (_full, _o, _cr) FROM si)", O_QWEN,
                             "CASE WHEN was_truncated THEN initial_round_text END"),
                   boxed_cte("b", "(SELECT * EXCLUDE (_full, _o, _cr) FROM s2)", "full_answer"),
                   norm_cte("nm", "b", "boxed", "reference")]

Q["eval_traces"] = with_(F3, RQ, fold_sql("f3", "2"),
                         "fj AS (SELECT fold.*, rq.reference FROM fold JOIN rq USING (question_id))",
                         split_cte("s", "fj", O_QWEN, "text"),
                         "si AS (SELECT * RENAME (thinking AS full_thinking, answer AS full_answer) FROM s)",
                         split_cte("s2", "(SELECT * EXCLUDE (_full, _o, _cr) FROM si)", O_QWEN, "initial_round_text"),
                         boxed_cte("b", "(SELECT * EXCLUDE (_full, _o, _cr) FROM s2)", "full_answer"),
                         norm_cte("nm", "b", "boxed", "reference")) + f"""
SELECT cast("repeat" as bigint) AS "repeat", 'math500' AS benchmark, question_id, reference, text AS raw_response,
 full_thinking AS thinking, full_answer AS final_answer_text, boxed AS extracted_answer, {math_correct()} AS is_correct,
 was_truncated, still_truncated, prompt_tokens, output_tokens, continuation_output_tokens,
 cast({words('full_thinking')} as bigint) AS reasoning_tokens,
 cast(CASE WHEN was_truncated THEN greatest(0, {words('full_thinking')} - {words('thinking')}) END as bigint) AS reasoning_tokens_added
FROM nm"""

PR_COLS = [
    "accuracy", "accuracy_excl_extended", "num_correct", "num_correct_excl_extended", "num_extended",
    "num_extended_correct", "num_extended_incorrect", "extended_accuracy", "num_still_truncated", "num_questions",
    "elapsed_seconds", "total_prompt_tokens", "total_output_tokens", "input_tokens_per_sec",
    "output_tokens_per_sec", "queries_per_sec", "mean_reasoning_tokens", "median_reasoning_tokens",
    "mean_extended_reasoning_tokens_added", "median_extended_reasoning_tokens_added"]
DOUBLE_PR = {"accuracy", "accuracy_excl_extended", "extended_accuracy", "elapsed_seconds", "input_tokens_per_sec",
             "output_tokens_per_sec", "queries_per_sec", "mean_reasoning_tokens", "median_reasoning_tokens",
             "mean_extended_reasoning_tokens_added", "median_extended_reasoning_tokens_added"}

Q["eval_run_stats"] = with_(*EVAL_TRACE_CTES, f"""t4 AS (
 SELECT 's1k11_all_dsr1_llama8b' AS dataset_name, 'cotgen' AS mode, 'math500' AS benchmark, 'run1' AS run_id,
  "repeat", question_id, {math_correct()} AS is_correct, was_truncated, still_truncated, prompt_tokens, output_tokens,
  cast({words('full_thinking')} as bigint) AS reasoning_tokens,
  cast(CASE WHEN was_truncated THEN greatest(0, {words('full_thinking')} - {words('thinking')}) END as bigint)
   AS reasoning_tokens_added,
  cast(10+"repeat" as double) AS elapsed_seconds FROM nm)""", G2_BODY) + f"""
SELECT {KEYS}, cast("repeat" as bigint) AS "repeat", """ + ", ".join(
    r9(c) + f" AS {c}" if c in DOUBLE_PR else f"cast({c} as bigint) AS {c}" for c in PR_COLS) + " FROM pr"

Q["repeat_stats"] = with_(F4, G2) + f"""
SELECT {KEYS}, cast("repeat" as bigint) AS "repeat", """ + ", ".join(
    r9(c) + f" AS {c}" if c in DOUBLE_PR else f"cast({c} as bigint) AS {c}" for c in PR_COLS) + " FROM pr"

RUN_OUT = [("num_repeats_completed", "b"), ("is_complete", "x"), ("num_questions", "b"),
           ("total_wall_clock_seconds", "d"), ("accuracy_mean", "d"), ("accuracy_std", "d"),
           ("accuracy_mean_excl_extended", "d"), ("accuracy_std_excl_extended", "d"), ("num_extended_total", "b"),
           ("num_extended_correct_total", "b"), ("num_extended_incorrect_total", "b"),
           ("extended_accuracy_mean", "d"), ("num_still_truncated_total", "b"),
           ("mean_extended_reasoning_tokens_added_mean", "d"), ("output_tokens_per_sec_mean", "d"),
           ("input_tokens_per_sec_mean", "d"), ("queries_per_sec_mean", "d"), ("mean_reasoning_tokens_mean", "d"),
           ("num_repeats", "b"), ("repeats", "x")]


def _typed(cols) -> str:
    out = []
    for c, t in cols:
        out.append(r9(c) + f" AS {c}" if t == "d" else (f"cast({c} as bigint) AS {c}" if t == "b" else c))
    return ", ".join(out)


Q["repeat_stats_spread"] = Q["repeat_stats"]
Q["run_summary"] = with_(F4, G2, RUNS) + f"SELECT {KEYS}, {_typed(RUN_OUT)} FROM runs"
Q["stream_run_summary"] = Q["run_summary"]
Q["stream_summary_files"] = Q["run_summary"]

Q["running_summary"] = with_(F4, G2) + f"""
SELECT {KEYS}, cast("repeat" as bigint) AS "repeat",
 count(*) OVER w AS num_repeats_completed, count(*) OVER w >= 3 AS is_complete, max(num_questions) OVER w AS num_questions,
 {r9('sum(elapsed_seconds) OVER w')} AS total_wall_clock_seconds,
 {r9('avg(accuracy) OVER w')} AS accuracy_mean, {r9('coalesce(stddev_samp(accuracy) OVER w, 0)')} AS accuracy_std,
 {r9('avg(accuracy_excl_extended) OVER w')} AS accuracy_mean_excl_extended,
 {r9('coalesce(stddev_samp(accuracy_excl_extended) OVER w, 0)')} AS accuracy_std_excl_extended,
 cast(sum(num_extended) OVER w as bigint) AS num_extended_total,
 cast(sum(num_extended_correct) OVER w as bigint) AS num_extended_correct_total,
 cast(sum(num_extended_incorrect) OVER w as bigint) AS num_extended_incorrect_total,
 {r9('avg(extended_accuracy) OVER w')} AS extended_accuracy_mean,
 cast(sum(num_still_truncated) OVER w as bigint) AS num_still_truncated_total,
 {r9('avg(mean_extended_reasoning_tokens_added) OVER w')} AS mean_extended_reasoning_tokens_added_mean,
 {r9('avg(output_tokens_per_sec) OVER w')} AS output_tokens_per_sec_mean,
 {r9('avg(input_tokens_per_sec) OVER w')} AS input_tokens_per_sec_mean,
 {r9('avg(queries_per_sec) OVER w')} AS queries_per_sec_mean,
 {r9('avg(mean_reasoning_tokens) OVER w')} AS mean_reasoning_tokens_mean
FROM pr WINDOW w AS (PARTITION BY {KEYS} ORDER BY "repeat" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

EVAL_CTES = [F4, G2, RUNS, F5]

Q["next_run_id"] = with_(*EVAL_CTES, """nr AS (SELECT dataset_name, mode, benchmark,
  CASE WHEN starts_with(file_name, _base||'_run') AND ends_with(file_name, '_summary.json')
        AND regexp_matches(substr(file_name, length(_base)+5, length(file_name)-length(_base)-4-13), '^[0-9]+$')
       THEN cast(substr(file_name, length(_base)+5, length(file_name)-length(_base)-4-13) as bigint) END AS n
  FROM (SELECT *, dataset_name||'_'||mode||'_'||benchmark AS _base FROM f5))""") + """
SELECT dataset_name, mode, benchmark, coalesce(max(n), 0) AS max_run,
 'run'||cast(coalesce(max(n), 0)+1 as varchar) AS next_run_id FROM nr GROUP BY dataset_name, mode, benchmark"""

Q["summary_records"] = with_(*EVAL_CTES) + """
SELECT dataset_name, mode, benchmark, run_id, model_family, checkpoint_dir, num_repeats,
 cast(num_repeats_completed as bigint) AS num_repeats_completed, is_complete, cast(32768 as bigint) AS max_new_tokens,
 cast(CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 4000 ELSE 32768 END as bigint) AS continuation_max_new_tokens,
 cast(CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 1 ELSE 2 END as bigint) AS max_continuation_rounds,
 'eval_results/'||dataset_name||'_'||mode||'_'||benchmark||'_'||run_id||'_traces.jsonl' AS trace_file,
 round(coalesce(temperature, 0.6), 9) AS temperature, round(coalesce(top_p, 0.95), 9) AS top_p,
 cast(CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 4 ELSE 2 END as bigint) AS num_params
FROM f5"""

Q["run_metadata_check"] = with_(*EVAL_CTES) + """
SELECT dataset_name, mode, benchmark, run_id, model_family,
 CASE WHEN mode='base' AND checkpoint_dir IS NOT NULL
      THEN 'base_with_checkpoint'
      WHEN mode<>'base' AND checkpoint_dir IS NULL THEN 'checkpoint_missing' END AS metadata_error,
 round(coalesce(temperature, 0.6), 9) AS temperature, round(coalesce(top_p, 0.95), 9) AS top_p,
 CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 20.0::double END AS top_k,
 CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 0.0::double END AS min_p,
 cast(CASE WHEN model_family IN ('qwen3','qwen3_0p6b','qwen3_4b') THEN 4 ELSE 2 END as bigint) AS num_params
FROM f5"""

TRAIN_COLS = """dataset_name, mode, status, gpu_ids, num_gpus, start_time, end_time, wall_clock_seconds,
 round(peak_gpu_memory_mib_total, 9) AS peak_gpu_memory_mib_total, round(train_runtime, 9) AS train_runtime,
 train_samples_per_second, train_steps_per_second, round(train_loss, 9) AS train_loss, round(total_flos, 9) AS total_flos,
 eval_loss, output_dir, config"""

Q["train_comparison"] = with_(F6) + f"""
SELECT {TRAIN_COLS}, source_path,
 printf('%dh%dm%ds', wall_clock_seconds // 3600, (wall_clock_seconds % 3600) // 60, wall_clock_seconds % 60) AS elapsed_text
FROM ts6"""

FINAL = f"""td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, mode
        ORDER BY end_time DESC, source_path DESC) AS _rn FROM ts6) WHERE _rn=1),
 fin AS (
 SELECT {MODEL.replace("dataset_name", "e.dataset_name")} AS model, {ABLATION.replace("dataset_name", "e.dataset_name")} AS ablation, e.mode AS training_method, e.benchmark, e.run_id,
  e.num_repeats AS num_eval_repeats, coalesce(e.num_repeats_completed, e.num_repeats) AS num_eval_repeats_completed,
  coalesce(e.is_complete, true) AS eval_is_complete,
  t.total_flos AS train_total_flos, t.train_runtime AS train_runtime_seconds,
  t.num_input_tokens_seen AS train_num_input_tokens_seen,
  CASE WHEN t.num_input_tokens_seen<>0 AND t.train_runtime<>0 THEN t.num_input_tokens_seen/t.train_runtime END AS train_tokens_per_sec,
  e.accuracy_mean AS eval_accuracy_mean, e.accuracy_std AS eval_accuracy_std,
  e.accuracy_mean_excl_extended AS eval_accuracy_mean_excl_extended,
  e.accuracy_std_excl_extended AS eval_accuracy_std_excl_extended,
  e.num_extended_total AS eval_num_extended_total, e.num_extended_correct_total AS eval_num_extended_correct_total,
  e.num_extended_incorrect_total AS eval_num_extended_incorrect_total,
  e.extended_accuracy_mean AS eval_extended_accuracy_mean, e.num_still_truncated_total AS eval_num_still_truncated_total,
  e.mean_extended_reasoning_tokens_added_mean AS eval_mean_extended_reasoning_tokens_added,
  e.output_tokens_per_sec_mean AS eval_output_tokens_per_sec_mean,
  e.input_tokens_per_sec_mean AS eval_input_tokens_per_sec_mean, e.queries_per_sec_mean AS eval_queries_per_sec_mean,
  e.mean_reasoning_tokens_mean AS eval_mean_reasoning_tokens, e.num_questions AS eval_num_questions
 FROM f5 e LEFT JOIN td t ON t.dataset_name=e.dataset_name AND t.mode=e.mode)"""

FIN_COLS = [("model", "x"), ("ablation", "x"), ("training_method", "x"), ("benchmark", "x"), ("run_id", "x"),
            ("num_eval_repeats", "b"), ("num_eval_repeats_completed", "b"), ("eval_is_complete", "x"),
            ("train_total_flos", "d"), ("train_runtime_seconds", "d"), ("train_num_input_tokens_seen", "b"),
            ("train_tokens_per_sec", "d"), ("eval_accuracy_mean", "d"), ("eval_accuracy_std", "d"),
            ("eval_accuracy_mean_excl_extended", "d"), ("eval_accuracy_std_excl_extended", "d"),
            ("eval_num_extended_total", "b"), ("eval_num_extended_correct_total", "b"),
            ("eval_num_extended_incorrect_total", "b"), ("eval_extended_accuracy_mean", "d"),
            ("eval_num_still_truncated_total", "b"), ("eval_mean_extended_reasoning_tokens_added", "d"),
            ("eval_output_tokens_per_sec_mean", "d"), ("eval_input_tokens_per_sec_mean", "d"),
            ("eval_queries_per_sec_mean", "d"), ("eval_mean_reasoning_tokens", "d"), ("eval_num_questions", "b")]

Q["final_table"] = with_(*EVAL_CTES, F6, FINAL) + f"SELECT {_typed(FIN_COLS)} FROM fin"

Q["missing_train_rows"] = with_(*EVAL_CTES, F6, FINAL) + """
SELECT model, ablation, training_method, benchmark, run_id FROM fin
WHERE train_total_flos IS NULL AND ablation<>'base'"""

BEST = f"""er AS (SELECT {MODEL} AS model, {ABLATION} AS ablation, benchmark, mode, run_id, accuracy_mean,
   coalesce(num_repeats_completed, num_repeats) AS num_repeats_completed, num_repeats AS num_repeats_target,
   coalesce(is_complete, true) AS is_complete, source_path FROM f5),
 best AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, ablation, benchmark, mode
   ORDER BY num_repeats_completed DESC, source_path) AS _rn FROM er) WHERE _rn=1)"""

Q["best_run_per_cell"] = with_(*EVAL_CTES, BEST) + """
SELECT model, ablation, benchmark, mode, run_id, round(accuracy_mean, 9) AS accuracy_mean,
 cast(num_repeats_completed as bigint) AS num_repeats_completed, cast(num_repeats_target as bigint) AS num_repeats_target,
 is_complete, source_path FROM best"""

_MODELS = "('qwen3'), ('dsr1_llama8b'), ('dsr1_qwen7b'), ('qwen3_0p6b'), ('qwen3_4b')"
Q["mode_pivot"] = with_(*EVAL_CTES, BEST, """cells AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ablation, benchmark, mode
   ORDER BY num_repeats_completed DESC, source_path) AS _rn FROM (
   SELECT model, ablation, benchmark, mode, accuracy_mean, source_path, num_repeats_completed,
     cast(num_repeats_completed as varchar)||'/'||cast(num_repeats_target as varchar) AS progress FROM er WHERE mode<>'base'
   UNION ALL
   SELECT model, a.ablation, benchmark, mode, accuracy_mean, source_path, num_repeats_completed,
     cast(num_repeats_completed as varchar)||'/'||cast(num_repeats_target as varchar) FROM er
     CROSS JOIN (VALUES ('all'), ('correct_only')) a(ablation) WHERE mode='base')) WHERE _rn=1),
 pv AS (SELECT model, ablation, benchmark,
   arg_min(accuracy_mean, source_path) FILTER (WHERE mode='base') AS base_acc,
   arg_min(progress, source_path) FILTER (WHERE mode='base') AS base_progress,
   arg_min(accuracy_mean, source_path) FILTER (WHERE mode='cotgen') AS cotgen_acc,
   arg_min(progress, source_path) FILTER (WHERE mode='cotgen') AS cotgen_progress,
   arg_min(accuracy_mean, source_path) FILTER (WHERE mode='cotcond') AS cotcond_acc,
   arg_min(progress, source_path) FILTER (WHERE mode='cotcond') AS cotcond_progress
  FROM cells GROUP BY model, ablation, benchmark)""",
    f"""sk AS (SELECT * FROM (VALUES {_MODELS}) m(model)
   CROSS JOIN (VALUES ('all'), ('correct_only')) a(ablation)
   CROSS JOIN (VALUES ('aime24'), ('aime25'), ('math500'), ('gpqa_diamond')) b(benchmark))""") + f"""
SELECT sk.model, sk.ablation, sk.benchmark, {r9('base_acc')} AS base_acc, base_progress,
 {r9('cotgen_acc')} AS cotgen_acc, cotgen_progress, {r9('cotcond_acc')} AS cotcond_acc, cotcond_progress,
 {r9('CASE WHEN cotgen_acc IS NOT NULL AND cotcond_acc IS NOT NULL AND cotgen_acc<>0 THEN (cotcond_acc-cotgen_acc)/cotgen_acc*100 END')} AS delta_cotcond_vs_cotgen_pct
FROM sk LEFT JOIN pv USING (model, ablation, benchmark)"""

Q["memory_peak"] = with_(F7, """per AS (SELECT run_id, sample_ts, sum(mem) AS total,
  count(*) FILTER (WHERE mem IS NULL) AS n_fail FROM f7 GROUP BY run_id, sample_ts)""") + f"""
SELECT run_id, {r9('CASE WHEN max(CASE WHEN n_fail=0 THEN total END)>0 THEN max(CASE WHEN n_fail=0 THEN total END) END')}
  AS peak_gpu_memory_mib_total, count(*) FILTER (WHERE n_fail=0) AS num_samples FROM per GROUP BY run_id"""
Q["stream_memory_peak"] = Q["memory_peak"]
Q["stream_memory_peak_bounded"] = Q["memory_peak"]

Q["stream_fold_rounds"] = Q["fold_rounds"]
Q["stream_worklist"] = Q["continuation_worklist"]

# ------------------------------------------------- written and read back again
Q["examples_roundtrip"] = Q["examples_required_fields"]
Q["examples_json_array"] = with_(F1) + """
SELECT ex_id, prompt, t AS thinking, a AS answer,
 concat_ws(',', CASE WHEN prompt IS NULL THEN 'prompt' END, CASE WHEN t IS NULL THEN 'thinking' END, CASE WHEN a IS NULL THEN 'answer' END) AS missing_fields
FROM (SELECT ex_id, prompt, CASE WHEN ex_id%1500>=100 THEN thinking END AS t, CASE WHEN ex_id%1000>=100 THEN answer END AS a FROM f1)"""
Q["records_roundtrip"] = with_(F1, SPLIT) + f"""
SELECT d.name||'_'||mode||'_'||split AS dataset_key, {sqlstr(SYSTEM_PROMPT)} AS system, human_from, human_value, gpt_from, gpt_value
FROM recs CROSS JOIN (VALUES ('s1k11_all_qwen3'), ('s1k11_correct_only_qwen3')) d(name)"""
Q["traces_roundtrip"] = Q["eval_traces"]
Q["eval_summaries_roundtrip"] = Q["summary_records"]
Q["train_summaries_roundtrip"] = with_(F6) + f"SELECT {TRAIN_COLS} FROM ts6"
Q["final_table_csv"] = Q["final_table"]
Q["first_questions"] = with_(BENCH) + "SELECT benchmark, pos, id, question, reference FROM bu QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY pos, id) <= 5"
Q["eval_row_defaults"] = with_(*EVAL_CTES) + f"""
SELECT {MODEL} AS model, {ABLATION} AS ablation, benchmark, mode, run_id, round(accuracy_mean, 9) AS accuracy_mean,
 cast(CASE WHEN run_id='run2' THEN num_repeats_completed ELSE num_repeats END as bigint) AS num_repeats_completed,
 cast(num_repeats as bigint) AS num_repeats_target, CASE WHEN run_id='run2' THEN is_complete ELSE true END AS is_complete,
 source_path FROM f5"""

ORACLE_SQL = dict(Q)
