"""Plain sequential folds used as oracles: one contest after the other, no windows."""

import math
from collections import defaultdict, deque

TIERS = {"premium": 36.0, "professional": 28.0, "amateur": 20.0, "excluded": 12.0}


def ordered(rows):
    valid = [r for r in rows if r["a_id"] and r["b_id"] and r["a_id"] > 0 and r["b_id"] > 0 and r["a_id"] != r["b_id"]]
    return sorted(valid, key=lambda r: (r["ts"], r["contest_id"]))


def elo(rows):
    rating, games, out = defaultdict(lambda: 1500.0), defaultdict(int), {}
    for r in ordered(rows):
        a, b = r["a_id"], r["b_id"]
        ra, rb, ga, gb = rating[a], rating[b], games[a], games[b]
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        k = TIERS.get(r["tier"] or "professional", 24.0)
        rating[a] += k * (1.25 if ga < 20 else 1) * (r["a_win"] - e)
        rating[b] += k * (1.25 if gb < 20 else 1) * (e - r["a_win"])
        games[a] += 1
        games[b] += 1
        out[(r["contest_id"],)] = {"contest_id": r["contest_id"], "a_rating": ra, "b_rating": rb, "a_games": ga, "b_games": gb, "a_expected": e}
    return out


def glicko_step(r, d, s, results, tau=0.5):
    """One player, one period, by bisection on the published equation (not the Illinois steps)."""
    q = 173.7178
    mu, phi = (r - 1500) / q, d / q
    inverse = gain = 0.0
    for orr, od, score in results:
        p = od / q
        g = 1 / math.sqrt(1 + 3 * p * p / math.pi ** 2)
        e = 1 / (1 + math.exp(-g * (mu - (orr - 1500) / q)))
        inverse += g * g * e * (1 - e)
        gain += g * (score - e)
    v = 1 / inverse
    delta2 = (v * gain) ** 2
    a = math.log(s * s)

    def f(x):
        ex = math.exp(x)
        return ex * (delta2 - phi * phi - v - ex) / (2 * (phi * phi + v + ex) ** 2) - (x - a) / tau ** 2

    low, high = a - 20, a + 20
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) > 0:
            low = mid
        else:
            high = mid
    s2 = math.exp(low / 2)
    phi2 = 1 / math.sqrt(1 / (phi * phi + s2 * s2) + inverse)
    return (mu + phi2 * phi2 * gain) * q + 1500, phi2 * q, s2


def glicko(rows):
    by_day = defaultdict(list)
    for r in ordered(rows):
        by_day[r["ts"] // 86_400].append(r)
    state, last, out = {}, {}, {}
    for day in sorted(by_day):
        games = defaultdict(list)
        for r in by_day[day]:
            games[r["a_id"]].append((r["b_id"], r["a_win"]))
            games[r["b_id"]].append((r["a_id"], 1 - r["a_win"]))
        before = {}
        for e in games:
            x = state.get(e, (1500.0, 350.0, 0.06))
            idle = max(0, day - last[e] - 1) if e in last else 0
            if idle:
                phi = x[1] / 173.7178
                x = (x[0], min(350.0, math.sqrt(phi * phi + idle * x[2] ** 2) * 173.7178), x[2])
            before[e] = x
        for e, played in games.items():
            after = glicko_step(*before[e], [(before[o][0], before[o][1], s) for o, s in played])
            out[(day, e)] = {"day": day, "entity_id": e, "rating_before": before[e][0], "deviation_before": before[e][1],
                             "rating_after": after[0], "deviation_after": after[1], "contests": len(played), "wins": sum(s for _, s in played)}
            state[e], last[e] = after, day
    return out


def features(rows):
    """Form, activity, era, pair, series and side features before each contest."""
    team = defaultdict(lambda: {"games": 0, "recent": [], "times": [], "ema": 0.5, "streak": 0, "last": None, "era": defaultdict(lambda: [0, 0])})
    pairs, series, side = defaultdict(lambda: [0, 0]), defaultdict(lambda: defaultdict(int)), deque(maxlen=500)
    smooth = lambda w, n, p: (w + 0.5 * p) / (n + p)
    out = {}
    for r in ordered(rows):
        a, b, now, era = team[r["a_id"]], team[r["b_id"]], r["ts"], r["era"] or 0
        lo, hi = sorted((r["a_id"], r["b_id"]))
        pw, pn = pairs[lo, hi]
        first = smooth(pw, pn, 8.0)
        key = (r["series_id"], lo, hi)
        sc = series[key] if r["series_id"] else {}
        sa, sb = sc.get(r["a_id"], 0), sc.get(r["b_id"], 0)
        rest = lambda t: 30.0 if t["last"] is None else min(30.0, max(0.0, (now - t["last"]) / 86_400))
        active = lambda t: sum(1 for x in t["times"] if x >= now - 30 * 86_400)
        recent = lambda t, n: smooth(sum(t["recent"][-n:]), len(t["recent"][-n:]), 6.0)
        clip = lambda x: max(-5, min(5, x))
        ea, eb = a["era"][era], b["era"][era]
        out[(r["contest_id"],)] = {
            "contest_id": r["contest_id"], "recent_5_difference": recent(a, 5) - recent(b, 5), "recent_10_difference": recent(a, 10) - recent(b, 10),
            "ema_difference": a["ema"] - b["ema"], "era_rate_difference": smooth(ea[0], ea[1], 10.0) - smooth(eb[0], eb[1], 10.0),
            "log_era_games_difference": math.log1p(ea[1]) - math.log1p(eb[1]), "a_rest_days": rest(a), "b_rest_days": rest(b),
            "activity_difference": float(active(a) - active(b)), "streak_difference": float(clip(a["streak"]) - clip(b["streak"])),
            "h2h_advantage": (first if r["a_id"] == lo else 1 - first) - 0.5, "log_pair_games": math.log1p(pn),
            "series_difference": float(sa - sb), "series_played": float(sa + sb), "side_rate": smooth(sum(side), len(side), 20.0)}
        for t, won in ((a, r["a_win"]), (b, 1 - r["a_win"])):
            t["games"] += 1
            t["recent"].append(won)
            t["times"].append(now)
            t["ema"] = 0.15 * won + 0.85 * t["ema"]
            t["streak"] = (t["streak"] + 1 if t["streak"] >= 0 else 1) if won else (t["streak"] - 1 if t["streak"] <= 0 else -1)
            t["last"] = now
            t["era"][era][0] += won
            t["era"][era][1] += 1
        pairs[lo, hi][0] += r["a_win"] if r["a_id"] == lo else 1 - r["a_win"]
        pairs[lo, hi][1] += 1
        if r["series_id"]:
            series[key][r["a_id"]] += r["a_win"]
            series[key][r["b_id"]] += 1 - r["a_win"]
        side.append(r["a_win"])
    return out
