import random

from tessera.operators import edits

CLIPS = "timeline long, track string, kind string, clip string, start long, dur long, off long, fade_in long, fade_out long, effects array<struct<id:string,value:double>>"
COMMANDS = "timeline long, command string, target string, ticks long, value double"


def plain(clips, command, target, ticks, value):
    """A timeline's clips as lists by track, edited one after another."""
    tracks = {}
    for c in sorted(clips, key=lambda c: (c["track"], c["start"], c["clip"])):
        tracks.setdefault(c["track"], []).append(dict(c, part=1))
    order = lambda t: t.sort(key=lambda c: c["start"])
    end = lambda c: c["start"] + c["dur"]

    def settle(t):
        order(t)
        for a, b in zip(t, t[1:]):
            if a["fade_out"] is not None and b["fade_in"] is not None:
                over = end(a) - b["start"]
                a["fade_out"], b["fade_in"] = (None, None) if over <= 0 else (min(a["fade_out"], over), min(b["fade_in"], over))

    done = lambda: [c for t in tracks.values() for c in t]
    found = [(n, i) for n in sorted(tracks) for i, c in enumerate(tracks[n]) if c["kind"] == "video" and target in (None, c["clip"])]
    if not found or command not in edits.COMMANDS:
        return done()
    name, i = found[0]
    track = tracks[name]
    clip = track[i]
    linked = [(n, c) for n in tracks for c in tracks[n] if c["kind"] == "audio" and (c["start"], c["dur"]) == (clip["start"], clip["dur"])]
    old_end, delta = end(clip), 0

    def ripple(first):
        for c in track[first:]:
            c["start"] = max(0, c["start"] + delta)
        settle(track)
        for n, t in tracks.items():
            if n != name and delta:
                for c in t:
                    if c["start"] >= old_end:
                        c["start"] = max(0, c["start"] + delta)
                settle(t)

    if command in ("grade", "retime"):
        fx = edits.GRADE if command == "grade" else edits.RETIME
        clip["effects"] = [e for e in clip["effects"] if e[0] != fx] + [(fx, value)]
    elif command == "trim_in":
        clip["off"] = max(0, ticks)
    elif command == "move":
        moved = max(0, ticks) - clip["start"]
        clip["start"] += moved
        settle(track)
        for n, c in linked:
            c["start"] = max(0, c["start"] + moved)
            settle(tracks[n])
    elif command == "blade":
        if clip["start"] < ticks < old_end:
            rest = dict(clip, part=2, start=ticks, dur=old_end - ticks, off=clip["off"] + ticks - clip["start"], fade_in=None)
            clip["dur"], clip["fade_out"] = ticks - clip["start"], None
            track.append(rest)
    elif command in ("trim_end", "ripple_trim_out", "ripple_trim_in"):
        off = max(0, ticks)
        dur = clip["dur"] - (off - clip["off"]) if command == "ripple_trim_in" else ticks - clip["start"]
        if dur > 0:
            delta = dur - clip["dur"]
            clip["dur"] = dur
            for _, c in linked:
                c["dur"] = dur
            if command == "ripple_trim_in":
                for c in [clip, *[c for _, c in linked]]:
                    c["off"] = off
            for n, _ in linked:
                settle(tracks[n])
            if command == "trim_end":
                settle(track)
            else:
                ripple(i + 1)
    else:
        delta = -clip["dur"]
        for n, c in [(name, clip), *linked]:
            at = tracks[n].index(c)
            if at:
                tracks[n][at - 1]["fade_out"] = None
            if at + 1 < len(tracks[n]):
                tracks[n][at + 1]["fade_in"] = None
            tracks[n].remove(c)
            if n != name:
                settle(tracks[n])
        ripple(i)
    return done()


def test_every_command_equals_one_timeline_after_another(spark):
    rng = random.Random(12)
    clips, commands, want = [], [], []
    for timeline in range(300):
        own = []
        for track, kind in (("A", "video"), ("B", "audio"), ("C", "video"), ("D", "audio")):
            at = 0
            for n in range(rng.randrange(5)):
                at += rng.randrange(1, 6) * 10  # no two clips of a track start together
                fade = lambda: rng.choice([None, 5, 25, 60])
                fx = rng.choice([[], [(edits.RETIME, 2.0)], [(edits.GRADE, 1.0), ("other", 3.0)]])
                own.append(dict(timeline=timeline, track=track, kind=kind, clip=f"{track}{n}", start=at, dur=rng.randrange(1, 9) * 10, off=rng.randrange(4) * 10, fade_in=fade(), fade_out=fade(), effects=fx))
        for c in [c for c in own if c["track"] == "A"]:
            if rng.random() < 0.5 and not any(o["track"] == "D" and o["start"] == c["start"] for o in own):
                own.append(dict(c, track="D", kind="audio", clip=c["clip"] + "s"))
        command = rng.choice([*edits.COMMANDS, "paint"])
        names = [c["clip"] for c in own if c["kind"] == "video"]
        target = rng.choice([None, "missing", *names, *names])
        ticks, value = rng.randrange(-3, 15) * 7, 0.5
        clips += own
        commands.append((timeline, command, target, ticks, value))
        want += plain(own, command, target, ticks, value)
    df = spark.createDataFrame([tuple(c.values()) for c in clips], CLIPS).repartition(4)
    got = edits.apply_commands(df, spark.createDataFrame(commands[:-5], COMMANDS))
    some = {c[0] for c in commands[:-5]}
    want = [c for c in want if c["timeline"] in some] + [dict(c, part=1) for c in clips if c["timeline"] not in some]  # without a command nothing changes
    key = lambda r: (r[0], r[1], r[3], r[4])
    plain_rows = sorted(((c["timeline"], c["track"], c["kind"], c["clip"], c["part"], c["start"], c["dur"], c["off"], c["fade_in"], c["fade_out"], [tuple(e) for e in c["effects"]]) for c in want), key=key)
    rows = sorted(((*r[:10], [tuple(e) for e in r.effects]) for r in got.collect()), key=key)
    assert len(rows) == len(plain_rows)
    for g, w in zip(rows, plain_rows):
        assert g == w, (g, w, commands[g[0]])


def test_clips_are_dealt_once(spark):
    """the clips went through a shuffle for every join and some windows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clips = spark.createDataFrame([(1, "V", "video", "a", 0, 10, 0, None, None, [])], CLIPS)
        plan = edits.apply_commands(clips, spark.createDataFrame([(1, "blade", None, 5, 0.0)], COMMANDS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(timeline") == 2
