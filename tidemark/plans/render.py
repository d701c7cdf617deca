"""Reports and alerts as text. Inputs are small: rows per rule, market or date, not data.

Python rounds halves to even here, as the fixed formats ask; SQL's formatting would not."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from tidemark.operators.evaluate import RETENTION

# ---- fixed values: headings of the tables that readers of these reports rely on
EVALUATION_COLUMNS = "signal_type,rule_id,selected,tuning_start,tuning_end,validation_start,validation_end,train_count,train_hit_rate,train_random_hit_rate,validation_count,validation_hit_rate,random_hit_rate,lift,ci_low,ci_high,retention,passed"
PAPER_COLUMNS = "section,key,trades,skipped_overlapping,incomplete_horizon,win_rate,net_pnl_pct,mean_pnl_pct,max_drawdown_pct,hodl_pnl_pct"
COVERAGE_COLUMNS = "date,trades,orderbooks,live_signals,markets,disconnected,stalled,total_gap_ms,longest_gap_ms"
SELECTED_HEAD = ["Signal type", "Selected rule", "Tuning", "Validation", "Train n / hit", "Validation n / hit", "Matched random", "Lift", "Corrected CI", "Retention", "Pass"]
CANDIDATE_HEAD = ["Signal type", "Rule", "Train n", "Train hit", "Matched random", "Selected"]
RULE_HEAD = ["Rule", "Trades", "Skipped (overlap)", "Incomplete", "Win rate", "Net P&L", "Mean / trade"]
MARKET_HEAD = ["Market", "Trades", "Net P&L", "Hold P&L"]
COVERAGE_HEAD = ["UTC date", "Trades", "Orderbooks", "Live signals", "Markets", "Disconnected", "Stalled", "Total gap ms", "Longest gap ms"]
#: Fixed wording: lines of alerts, verdicts and reports, which scripts and readers search for.
NO_RECORD = "  track: validation record unavailable\n"
NO_RULES = "GATE: FAIL — no selected rules\n"
TOO_FEW, NOT_POSITIVE, NOT_KEPT = "insufficient validation sample ({n}/{least})", "CI lower bound is non-positive", "retention below 80% ({kept})"
TIE, WINS = "VERDICT: TIE at 0.000pp over {window}", "VERDICT: {who} WINS by {by:.3f}pp over {window}"
NO_TRADE = "\nNo qualified signal produced a paper trade in this window.\n"
NO_FOOTPRINT = "Not enough collected data to project a footprint; {days} complete UTC dates required before analyze can run.\n"
FOOTPRINT = "Footprint: {gb:.1f} GB in {files:,} files over {span} of collection → {all_gb:.1f} GB and {all_files:,} files projected for {days} dates.\n"
COVERAGE_FIELDS = ["date", "trades", "books", "signals", "markets", "disconnected", "stalled", "gap_ms", "max_gap_ms"]


def table(head: list[str], align: str, rows: list[list]) -> str:
    """A Markdown table; ``align`` has l or r per column."""
    rule = "".join("---:|" if a == "r" else "---|" for a in align)
    body = "".join("| " + " | ".join(map(str, r)) + " |\n" for r in rows)
    return "| " + " | ".join(head) + " |\n|" + rule + "\n" + body


def pct(share: float, sign: str = "") -> str:
    return f"{share * 100:{sign}.1f}%"


def yes(flag: bool) -> str:
    return "yes" if flag else "no"


def alert(s, record: dict | None, window: dict | None = None) -> str:
    """The block printed for one signal, with its rule's validation record."""
    at = datetime.fromtimestamp(s["ts"] / 1e6, UTC).isoformat()
    out = f"ALERT {at}  {s['market']}  {s['direction'].upper()}  {s['signal_type']}\n  why:   {s['rationale']}\n  rule:  {s['signal_type']}:{s['rule_id']}\n"
    if not record:
        return out + NO_RECORD
    r, w = record, window or record
    lift = r["val_rate"] - r["val_control"]
    return out + (
        f"  track: validation n={r['val_n']}, hit {pct(r['val_rate'])} vs {pct(r['val_control'])} matched-random, lift {pct(lift, '+')},\n"
        f"         corrected CI [{pct(r['ci_low'], '+')}, {pct(r['ci_high'], '+')}], retention {pct(r['retention'])}\n"
        f"         tuned {w['tuning_start']}–{w['tuning_end']}, validated {w['validation_start']}–{w['validation_end']}\n"
    )


def _found(audit: dict) -> dict[str, dict]:
    return {r["rule_key"]: r for r in audit["results"]}


def _dates(audit: dict) -> list[str]:
    return [audit[k] for k in ("tuning_start", "tuning_end", "validation_start", "validation_end")]


def evaluation_csv(audit: dict) -> str:
    """One line per candidate; validation fields are blank for those not selected."""
    lines, results = [EVALUATION_COLUMNS], _found(audit)
    for c in audit["candidates"]:
        r = results.get(c["rule_key"])
        row = [c["signal_type"], c["rule_key"], str(r is not None).lower(), *_dates(audit), c["n"], f"{c['hit_rate']:.4f}", f"{c['control_rate']:.4f}"]
        if r:
            shares = [r["val_rate"], r["val_control"], r["val_rate"] - r["val_control"], r["ci_low"], r["ci_high"], r["retention"]]
            row += [r["val_n"], *(f"{x:.4f}" for x in shares), str(r["passed"]).lower()]
        else:
            row += [""] * 8
        lines.append(",".join(map(str, row)))
    return "\n".join(lines) + "\n"


def gate_verdict(audit: dict) -> str:
    passed = [r["rule_key"] for r in audit["results"] if r["passed"]]
    if passed:
        return f"GATE: PASS — {', '.join(passed)}\n"
    if not audit["results"]:
        return NO_RULES
    least = audit["min_validation_signals"]

    def reasons(r: dict) -> str:
        tests = {
            TOO_FEW.format(n=r["val_n"], least=least): r["val_n"] < least,
            NOT_POSITIVE: r["ci_low"] <= 0,
            NOT_KEPT.format(kept=pct(r["retention"])): r["retention"] < RETENTION,
        }
        return f"{r['rule_key']}: " + ", ".join(text for text, failed in tests.items() if failed)

    return "GATE: FAIL — " + "; ".join(map(reasons, audit["results"])) + "\n"


def evaluation_markdown(audit: dict) -> str:
    results, (t0, t1, v0, v1) = _found(audit), _dates(audit)
    train = {c["rule_key"]: c for c in audit["candidates"]}
    chosen = [
        [r["signal_type"], k, f"{t0}–{t1}", f"{v0}–{v1}", f"{train[k]['n']} / {pct(train[k]['hit_rate'])}", f"{r['val_n']} / {pct(r['val_rate'])}", pct(r["val_control"]),
         pct(r["val_rate"] - r["val_control"]), f"[{pct(r['ci_low'])}, {pct(r['ci_high'])}]", pct(r["retention"]), yes(r["passed"])]
        for k, r in results.items()
    ]
    tried = [[c["signal_type"], k, c["n"], pct(c["hit_rate"]), pct(c["control_rate"]), yes(k in results)] for k, c in train.items()]
    corrected = "enabled" if audit["family_wise_correction"] else "disabled"
    return (
        f"# Validation report\n\n## Selected rules\n\n{table(SELECTED_HEAD, 'llllllrrlrl', chosen)}"
        f"\nFamily size: {audit['family_size']}; effective tail alpha: {audit['effective_tail_alpha']:.6f} (family-wise correction: {corrected}).\n"
        f"\n## All tuning candidates\n\n{table(CANDIDATE_HEAD, 'llrrrl', tried)}"
        f"\n```json\n{json.dumps(audit, indent=2, ensure_ascii=False)}\n```\n\n{gate_verdict(audit)}"
    )


def paper_verdict(study: dict) -> str:
    excess, window = study["total"]["excess_pct"], f"{study['start']}–{study['end']}"
    if not excess:
        return TIE.format(window=window)
    return WINS.format(who="STRATEGY" if excess > 0 else "HOLD", by=abs(excess), window=window)


def _wins(row: dict) -> float:
    return row["wins"] / max(row["trades"], 1)


def paper_csv(study: dict) -> str:
    counts = lambda r: [r["trades"], r["skipped"], r["incomplete"], f"{_wins(r):.4f}"]
    four = lambda *xs: [f"{x:.4f}" for x in xs]
    total, rules = study["total"], study["rules"]
    mean = sum(r["mean_net_pct"] * r["trades"] for r in rules) / max(sum(r["trades"] for r in rules), 1)
    rows = [["rule", r["rule_key"], *counts(r), *four(r["return_pct"], r["mean_net_pct"]), "", ""] for r in rules]
    rows += [["market", m["market"], *counts(m), *four(m["return_pct"], m["mean_net_pct"]), "", *four(m["hold_pct"])] for m in study["markets"]]
    rows += [["total", "ALL", *counts(total), *four(total["strategy_pct"], mean, total["max_drawdown_pct"], total["hold_pct"])]]
    return "\n".join([PAPER_COLUMNS, *(",".join(map(str, r)) for r in rows), paper_verdict(study)]) + "\n"


def paper_markdown(study: dict) -> str:
    total, n = study["total"], study["total"]["markets"]
    markets = f"{n} market{'' if n == 1 else 's'}"
    signed = lambda x: f"{x:+.3f}%"
    rules = [[r["rule_key"], r["trades"], r["skipped"], r["incomplete"], pct(_wins(r)), signed(r["return_pct"]), signed(r["mean_net_pct"])] for r in study["rules"]]
    per_market = [[m["market"], m["trades"], signed(m["return_pct"]), signed(m["hold_pct"])] for m in study["markets"]]
    none = "" if total["trades"] else NO_TRADE
    return (
        f"# Paper study\n\nWindow: {study['start']}–{study['end']} (validation only) · {markets} · horizon {study['horizon_minutes']}m · fees {study['fee_bps']:g}bps, slippage {study['slippage_bps']:g}bps\n\n"
        f"{table(RULE_HEAD, 'lrrrrrr', rules)}\n{table(MARKET_HEAD, 'lrrr', per_market)}{none}"
        f"\nStrategy: {signed(total['strategy_pct'])} net, max drawdown {total['max_drawdown_pct']:.3f}%, {total['trades']} trades, {total['skipped']} skipped for overlap, {total['incomplete']} incomplete.\n"
        f"Hold:     {signed(total['hold_pct'])} (equal weight over the same {markets}, one round trip).\n\n"
        f"{paper_verdict(study)}\n"
    )


def coverage(rows: list[dict], csv: bool) -> str:
    cells = [[r[f] for f in COVERAGE_FIELDS] for r in rows]
    if csv:
        return "\n".join([COVERAGE_COLUMNS, *(",".join(map(str, c)) for c in cells)]) + "\n"
    return f"# Collection coverage\n\n{table(COVERAGE_HEAD, 'lrrrrrrrr', cells)}\n"


def span(seconds: int) -> str:
    """Seconds as 119s, 119m, 47.9h or 2.0d."""
    if seconds < 7200:
        return f"{seconds}s" if seconds < 120 else f"{seconds // 60}m"
    return f"{seconds / 3600:.1f}h" if seconds < 172_800 else f"{seconds / 86_400:.1f}d"


def footprint(n_bytes: int, files: int, observed: int, days: int) -> str:
    """What ``days`` of the same rate will take, in decimal GB; scaled by seconds observed, not dates."""
    if observed <= 0:
        return NO_FOOTPRINT.format(days=days)
    scale = days * 86_400 / observed
    return FOOTPRINT.format(gb=n_bytes / 1e9, files=files, span=span(observed), all_gb=n_bytes * scale / 1e9, all_files=int(files * scale + 0.5), days=days)
