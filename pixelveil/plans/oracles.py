"""DuckDB SQL with the results of the queries, by other means: neighbours by joins on offsets, systems by elimination in long form."""

from __future__ import annotations

BYTE = "cast(floor(greatest(0, least(255, 128 + cast(e as double) * 240))) as bigint)"
PLANE = f"""px as materialized (
  select cast(0 as bigint) img, vec_id r, cast(pos as bigint) c, {BYTE} v
  from (select vec_id, unnest(range(0, 64)) pos, unnest(embedding) e from embeddings))"""
FRAMES = f"""fr as materialized (
  select stream_id, frame_no, cast(floor(pos / 8) as bigint) r, cast(pos % 8 as bigint) c, {BYTE} v
  from (select stream_id, frame_no, unnest(range(0, 64)) pos, unnest(embedding) e
        from (select cast(label as bigint) stream_id, row_number() over (partition by label order by vec_id) - 1 frame_no, embedding from embeddings)))"""
IMAGES = FRAMES + ", px as materialized (select stream_id * 1000000 + frame_no img, r, c, v from fr)"
RGB = (
    PLANE
    + """, rgb as materialized (
  select img, cast(floor(r / 3) as bigint) r, c, max(case when r % 3 = 0 then v end) red, max(case when r % 3 = 1 then v end) green, max(case when r % 3 = 2 then v end) blue,
    cast(max(case when (cast(floor(r / 3) as bigint) * 64 + c) % 7 = 0 then 0 else 255 end) as integer) alpha
  from px where r < (select count(*) // 3 * 3 from embeddings) group by img, cast(floor(r / 3) as bigint), c)"""
)
SIGNAL = """sqrt(-2 * ln((1 + (({r} * 7919 + {c} * 104729 + 28390211) * 48271) % 2147483647) / 2147483648.0::double))
  * cos(6.283185307179586::double * ((({r} * 15485863 + {c} * 32452843 + 17) * 16807) % 2147483647) / 2147483647.0::double)"""
W = SIGNAL.format(r="r", c="c")
TARGET = "(255.0::double / sqrt(power(10.0::double, 40.0 / 10.0)))"


def near(px: str, out: str, p: int, border: str) -> str:
    """``out``: (img, r, c, v, k, x) for the neighbours k in row order, and the centre as k = -1."""
    pad = p // 2
    cells = [(i - pad, j - pad) for i in range(p) for j in range(p)]
    ks, k = [], 0
    for dr, dc in cells:
        ks.append((-1 if dr == dc == 0 else k, dr, dc))
        k += dr != 0 or dc != 0
    rows = ", ".join(map(str, ks))
    if border == "zero":
        at = "q.r = a.r + o.dr and q.c = a.c + o.dc"
    else:
        at = "q.r = greatest(0, least(s.h, a.r + o.dr)) and q.c = greatest(0, least(s.w, a.c + o.dc))"
    return f"""{out} as materialized (
  select a.img, a.r, a.c, a.v, o.k, coalesce(q.v, 0) x
  from {px} a join (select img, max(r) h, max(c) w from {px} group by img) s on s.img = a.img cross join (values {rows}) o(k, dr, dc)
  left join {px} q on q.img = a.img and {at})"""


def fitted(px: str, t: str, border: str, p: int = 3) -> str:
    """CTEs ``{t}n`` (neighbours), ``{t}k`` (coefficients) and ``{t}e`` (img, r, c, v, e)."""
    n = p * p - 1
    out = [near(px, f"{t}n", p, border)]
    out.append(f"""{t}m0 as materialized (
  select a.img, a.k i, case when b.k < 0 then {n} else b.k end j, cast(sum(cast(a.x as double) * b.x) as double) a
  from {t}n a join {t}n b on a.img = b.img and a.r = b.r and a.c = b.c where a.k >= 0 group by all)""")
    out.append(f"{t}t as materialized (select img, sum(a) trace from {t}m0 where i = j group by img)")
    for s in range(n):
        out.append(f"""{t}m{s + 1} as materialized (
  select m.img, m.i, m.j, case when m.i = {s} then m.a / p.a else m.a - c.a * w.a / p.a end a
  from {t}m{s} m
  join (select x.img, case when x.a > 0 and x.a >= trace * 1e-10 then x.a end a from {t}m{s} x join {t}t using (img) where i = {s} and j = {s}) p on p.img = m.img
  join {t}m{s} c on c.img = m.img and c.i = m.i and c.j = {s} join {t}m{s} w on w.img = m.img and w.i = {s} and w.j = m.j)""")
    out.append(f"{t}k as materialized (select img, i, a k from {t}m{n} where j = {n})")
    out.append(f"""{t}e as materialized (
  select n.img, n.r, n.c, any_value(n.v) v, any_value(n.v) - sum(n.x * k.k) e from {t}n n join {t}k k on k.img = n.img and k.i = n.k group by n.img, n.r, n.c)""")
    return ",\n".join(out)


def _moments(px: str, p: int, border: str) -> str:
    return near(px, "nb", p, border) + ", mo as materialized (select img, r, c, cast(sum(x) as bigint) total, cast(sum(x * x) as bigint) squares from nb group by img, r, c)"


def _nvf(p: int) -> str:
    n = p * p
    var = f"(greatest({n} * squares - total * total, 0) / {n * n}.0::double)"
    return f"{var} / (1 + {var})"


def masked(px: str, t: str, mask: str, border: str, p: int = 3, w: str = W) -> str:
    """CTE ``{t}u``: (img, r, c, v, u), mask times signal."""
    if mask == "NVF":
        head = near(px, f"{t}nb", p, border) + f", {t}mo as (select img, r, c, any_value(v) v, sum(x) total, sum(x * x) squares from {t}nb group by img, r, c)"
        return f"{head}, {t}u as materialized (select img, r, c, v, {_nvf(p)} * {w} u from {t}mo)"
    if mask == "LEVEL":  # a mask of its own: the pixel's level
        return f"{t}u as materialized (select img, r, c, v, v / 255.0::double * {w} u from {px})"
    return f"{fitted(px, t, border, p)}, {t}u as materialized (select img, r, c, v, abs(e) / nullif(max(abs(e)) over (partition by img), 0) * {w} u from {t}e)"


def marked(px: str, t: str, mask: str, border: str, p: int = 3, w: str = W) -> str:
    """CTEs ``{t}s`` (img, strength) and ``{t}y`` (img, r, c, y)."""
    return f"""{masked(px, t, mask, border, p, w)},
{t}s as materialized (select img, {TARGET} / sqrt(nullif(avg(u * u), 0)) strength from {t}u group by img),
{t}y as materialized (select img, r, c, cast(floor(greatest(0, least(255, v + coalesce(strength * u, 0)))) as bigint) y from {t}u join {t}s using (img))"""


def scores(px: str, t: str, mask: str, border: str, p: int = 3, w: str = W) -> str:
    """CTE ``{t}d``: (img, correlation) of the pixels ``px``."""
    head = fitted(px, t, border, p)
    if mask == "NVF":
        head += ", " + near(px, f"{t}nb", p, border) + f", {t}mo as (select img, r, c, sum(x) total, sum(x * x) squares from {t}nb group by img, r, c)"
        head += f", {t}u as materialized (select img, r, c, {_nvf(p)} * {w} v from {t}mo)"
    elif mask == "LEVEL":
        head += f", {t}u as materialized (select img, r, c, v / 255.0::double * {w} v from {px})"
    else:
        head += f", {t}u as materialized (select img, r, c, coalesce(abs(e) / nullif(max(abs(e)) over (partition by img), 0), 0) * {w} v from {t}e)"
    return f"""{head}, {near(f"{t}u", f"{t}un", p, border)},
{t}f as (select n.img, n.r, n.c, any_value(n.v) - sum(n.x * k.k) e from {t}un n join {t}k k on k.img = n.img and k.i = n.k group by n.img, n.r, n.c),
{t}d as (select img, coalesce(sum(z.e * f.e) / nullif(sqrt(sum(z.e * z.e) * sum(f.e * f.e)), 0), 0) correlation from {t}e z join {t}f f using (img, r, c) group by img)"""


def _detect(mask: str, border: str, p: int = 3, w: str = W) -> str:
    return f"with {PLANE}, {marked('px', 'p', mask, border, p, w)}, marked as (select img, r, c, y v from py), {scores('marked', 'b', mask, border, p, w)} select img, round(correlation, 6) correlation from bd"


def _embed(mask: str, border: str, p: int = 3, w: str = W) -> str:
    return f"with {PLANE}, {marked('px', 'p', mask, border, p, w)} select * from py"


def _near_sums(p: int, border: str) -> str:
    return f"with {PLANE}, {near('px', 'n', p, border)} select img, cast(k as integer) k, cast(sum(x) as bigint) total, cast(sum((r * 64 + c) % 9973 * x) as bigint) mixed from n where k >= 0 group by img, k"


def _gram(border: str, p: int = 3) -> str:
    return f"""with {PLANE}, {near("px", "n", p, border)}
select a.img, cast(a.k as integer) i, cast(case when b.k < 0 then {p * p - 1} else b.k end as integer) j, cast(sum(a.x * b.x) as bigint) g
from n a join n b on a.img = b.img and a.r = b.r and a.c = b.c where a.k >= 0 and b.k <= a.k group by all"""


def _near(p: int, border: str) -> str:
    return f"with {PLANE}, {near('px', 'n', p, border)} select img, r, c, cast(k as integer) k, x from n where k >= 0"


def _window(p: int, border: str) -> str:
    return f"with {PLANE}, {_moments('px', p, border)} select * from mo"


def _mask(p: int, border: str) -> str:
    return f"with {PLANE}, {_moments('px', p, border)} select img, r, c, round({_nvf(p)}, 6) m from mo"


def _coefs(border: str) -> str:
    return f"with {PLANE}, {fitted('px', 'p', border)} select img, cast(i as integer) i, round(k, 6) k from pk"


def _me(border: str) -> str:
    return f"with {PLANE}, {fitted('px', 'p', border)} select img, r, c, round(abs(e) / nullif(max(abs(e)) over (partition by img), 0), 6) m from pe"


def oracle_sql() -> dict[str, str]:
    gray = "0.299::double * red + 0.587::double * green + 0.114::double * blue"
    black = ", ".join(f"case when alpha = 0 then 0 else {c} end {c}" for c in ("red", "green", "blue"))
    frames_marked = f"with {IMAGES}, every as (select px.* from px where img % 1000000 % 10 = 0), {marked('every', 'p', 'ME', 'zero')}"
    q = {
        "gray_from_rgb": f"with {RGB} select img, r, c, round({gray}, 6) v from rgb",
        "alpha_zero": f"with {RGB} select img, r, c, {black}, alpha from rgb",
        "channel_pivot": f"with {RGB} select img, r, c, red, green, blue from rgb",
        "channel_unpivot": f"with {RGB} select img, r, c, 0 ch, red v from rgb union all select img, r, c, 1, green from rgb union all select img, r, c, 2, blue from rgb",
        "stride_compact": f"with {PLANE} select img, r, c, v from px where c < 60",
        "transpose": f"with {PLANE} select img, c r, r c, v from px",
        "row_arrays": f"with {PLANE} select img, r, count(*) n, string_agg(cast(v as varchar), ',' order by c) px from px group by img, r",
        "text_planes": """select img, max(n_rows) n_rows, cast(sum(v) as bigint) total, cast(sum((r * 64 + c + 1) * v % 9973) as bigint) mixed from (
  select doc_id img, n_rows, cast(floor(pos / 64) as bigint) r, cast(pos % 64 as bigint) c, cast(unicode(ch) as bigint) v
  from (select doc_id, (length(text) + 63) // 64 n_rows, unnest(range(0, length(text))) pos, unnest(string_split(text, '')) ch from documents where length(text) > 0)) group by img""",
        "event_frames": """select cast(0 as bigint) stream_id, cast(floor(event_id / 64) as bigint) frame_no, cast(floor((event_id % 64) / 8) as bigint) r, cast(event_id % 8 as bigint) c, cast(floor(greatest(0, least(255, value))) as bigint) v
from events where event_id < 64 * floor((select count(*) from events) / 64)""",
        "signal_plane": f"with {PLANE} select r, c, round({W}, 6) w from px",
        "signal_size_check": f"with {IMAGES} select img, max(r) + 1 as rows, max(c) + 1 cols, cast(8 as bigint) signal_rows, cast(9 as bigint) signal_cols from px group by img having max(r) + 1 <> 8 or max(c) + 1 <> 9",
        "dense_check": f"with {IMAGES} select img, count(*) n, (max(r) + 1) * (max(c) + 1) cells from px where not (r = 3 and c = 3 and img % 5 = 0) group by img having count(*) <> (max(r) + 1) * (max(c) + 1)",
        "nvf_mask_zero": _mask(3, "zero"),
        "nvf_mask_edge": _mask(3, "edge"),
        "nvf_mask_p9_edge": _mask(9, "edge"),
        "predictor_coefficients": _coefs("zero"),
        "predictor_coefficients_edge": _coefs("edge"),
        "residual": f"with {PLANE}, {fitted('px', 'p', 'zero')} select img, r, c, round(e, 6) e from pe",
        "me_mask": _me("zero"),
        "me_mask_edge": _me("edge"),
        "embed_nvf_gray": _embed("NVF", "zero"),
        "embed_me_gray": _embed("ME", "zero"),
        "embed_me_gray_edge": _embed("ME", "edge"),
        "embed_me_rgb": f"""with {RGB}, clean as materialized (select img, r, c, {black}, alpha from rgb), gp as materialized (select img, r, c, {gray} v from clean), {marked("gp", "p", "ME", "zero")}
select img, r, c, {", ".join(f"cast(floor(greatest(0, least(255, {x} + coalesce(strength * u, 0)))) as bigint) {x}" for x in ("red", "green", "blue"))}, alpha
from clean join pu using (img, r, c) join ps using (img)""",
        "strength": f'with {PLANE}, {marked("px", "p", "ME", "zero")} select img, round(strength, 6) strength from ps',
        "psnr_check": f'with {PLANE}, {marked("px", "p", "ME", "zero")} select img, round(10 * log10(65025.0 / avg(power(strength * u, 2))), 6) psnr from pu join ps using (img) group by img',
        "detect_nvf": _detect("NVF", "zero"),
        "detect_me": _detect("ME", "zero"),
        "detect_me_edge": _detect("ME", "edge"),
        "detect_unmarked": f"with {PLANE}, {scores('px', 'b', 'ME', 'zero')} select img, round(correlation, 6) correlation from bd",
        "arrow_embed": f"with {IMAGES}, {marked('px', 'p', 'ME', 'zero')} select * from py",
        "arrow_detect": f"with {IMAGES}, {scores('px', 'b', 'ME', 'zero')} select img, round(correlation, 6) correlation from bd",
        "relational_detect_frames": f"with {IMAGES}, {scores('px', 'b', 'ME', 'zero')} select img, round(correlation, 6) correlation from bd",
        "frame_sample": f"with {FRAMES} select * from fr where frame_no % 30 = 0",
        "frame_embed_interval": f"{frames_marked} select img // 1000000 stream_id, img % 1000000 frame_no, r, c, y v from py union all select stream_id, frame_no, r, c, v from fr where frame_no % 10 <> 0",
        "frame_detect_interval": f"with {IMAGES}, every as (select px.* from px where img % 1000000 % 10 = 0), {scores('every', 'b', 'ME', 'zero')} select img // 1000000 stream_id, img % 1000000 + 1 frame, round(correlation, 6) correlation from bd",
        "frame_count": f"with {FRAMES} select stream_id, count(distinct frame_no) frames from fr group by stream_id",
        "frame_numbers": "select cast(label as bigint) stream_id, vec_id, row_number() over (partition by label order by vec_id) - 1 frame_no from embeddings",
        "first_video_stream": "select user_id source, min(event_id) stream_index from events where event_id % 3 <> 0 group by user_id",
        "output_suffix": r"select path, regexp_replace(path, '(\.[^.]+)$', '_W_ME\1') marked from (select 'out.d/img' || p_partkey || case when p_partkey % 2 = 0 then '.png' else '.tar.JPG' end path from part)",
        "frame_rate": "select o_orderkey, round((o_orderkey % 7 * 1000 + 30)::double / nullif((o_orderkey % 5 * 125)::double, 0), 3) rate from orders",
        "window_moments_p5_edge": _window(5, "edge"),
        "neighbours_p5_edge": _near(5, "edge"),
    }
    black_rgb = f"{RGB}, clean as materialized (select img, r, c, {black}, alpha from rgb), gp as materialized (select img, r, c, {gray} v from clean)"
    seven = SIGNAL.replace("28390211", "7").format(r="r", c="c")
    single = f"cast({W} as float)::double"
    flat = "select vec_id img, cast(pos // 8 as bigint) r, cast(pos % 8 as bigint) c, cast(label * 7 as bigint) y, cast(null as double) strength from (select vec_id, label, unnest(range(0, 64)) pos from embeddings)"
    hex8 = "string_agg(printf('%02X', v), '' order by r, c)"
    rgb_marked = ", ".join(f"cast(floor(greatest(0, least(255, {x} + coalesce(strength * u, 0)))) as bigint) {x}" for x in ("red", "green", "blue"))
    interval = q["frame_embed_interval"]
    q |= {
        "nvf_mask_p7_edge": _mask(7, "edge"),
        "embed_nvf_p5": _embed("NVF", "zero", 5),
        "embed_nvf_p7_edge": _embed("NVF", "edge", 7),
        "embed_nvf_p9": _embed("NVF", "zero", 9),
        "embed_me_p5": _embed("ME", "zero", 5),
        "embed_me_p5_edge": _embed("ME", "edge", 5),
        "detect_me_p5": _detect("ME", "zero", 5),
        "detect_nvf_edge": _detect("NVF", "edge"),
        "embed_nvf_rgb": f"""with {black_rgb}, {marked("gp", "p", "NVF", "zero")} select img, r, c, {rgb_marked}, alpha from clean join pu using (img, r, c) join ps using (img)""",
        "embed_stored_signal": _embed("ME", "zero", 3, seven),
        "detect_stored_signal": _detect("NVF", "zero", 3, seven),
        "signal_file": f"with {PLANE} select r, c, round({single}, 6) w from px",
        "signal_table": f"with {PLANE} select r, c, round({W}, 6) w from px",
        "image_files": f"with {RGB} select r img, cast(c // 8 as bigint) r, cast(c % 8 as bigint) c, {black}, cast(alpha as bigint) alpha from rgb",
        "embed_custom_mask": _embed("LEVEL", "zero"),
        "detect_custom_mask": _detect("LEVEL", "zero"),
        "flat_planes_embed": flat,
        "flat_planes_detect": "select vec_id img, 0.0::double correlation from embeddings",
        "strided_frames": f"with {FRAMES} select stream_id, frame_no, r, c, v from fr",
        "strided_chroma": f"""with {FRAMES} select stream_id, frame_no, cast(8 as integer) linesize, cast(64 as bigint) y_bytes,
  {hex8.replace("r, c)", "r, c) filter (r < 2)")} u, {hex8.replace("r, c)", "r, c) filter (r >= 2 and r < 4)")} v from fr group by stream_id, frame_no""",
        "chroma_passes": f"""with {FRAMES} select stream_id, frame_no, cast(8 as integer) width, {hex8.replace("r, c)", "r, c) filter (r < 2)")} u, {hex8.replace("r, c)", "r, c) filter (r >= 2 and r < 4)")} v from fr group by stream_id, frame_no""",
        "pixel_formats": f"with {FRAMES} select distinct stream_id, frame_no, case when frame_no % 2 = 0 then 'yuv420p' else 'yuvj420p' end pixel_format from fr",
        "process_embeds": interval,
        "process_detects": q["frame_detect_interval"],
        "streamed_embed": interval,
        "streamed_detect": q["frame_detect_interval"],
        "packet_filter": """with p as (select user_id source, event_id % 4 stream_index, case when event_id % 4 in (1, 2) then 'video' else 'audio' end type, event_id, event_id % 5 <> 0 accepted from events),
  f as (select source, min(stream_index) stream_index from p where type = 'video' group by source)
select p.source, p.stream_index, p.event_id from p join f using (source, stream_index) where accepted""",
        "report_scores": f"""with {IMAGES}, {marked('px', 'p', 'ME', 'zero')}, {scores('px', 'b', 'ME', 'zero')}
select img, 'ME' mask, cast(3 as integer) p, 40.0::double psnr, round(strength, 6) strength, round(correlation, 6) correlation, 1.5::double as seconds, '0.750000' as time from bd join ps using (img)""",
        "duration_texts": "select o_orderkey, printf('%.6f', (o_orderkey % 488 * 2 + 1) / 1009.0::double) as seconds, printf('%.2f', 1.0::double / ((o_orderkey % 488 * 2 + 1) / 1009.0::double)) rate from orders",
        "settings_values": "select cast(n_regionkey as varchar) as source, lower(n_name) as section, n_nationkey::bigint as number, n_nationkey / 8.0::double as real, n_nationkey % 2 = 0 as flag, 'a #' || n_nationkey || '.png' || chr(10) || n_name as name from nation",
        "image_files_bmp": f"with {RGB} select r img, cast(c // 8 as bigint) r, cast(c % 8 as bigint) c, red, green, blue, cast(null as bigint) alpha from rgb",
        "marker_embeds": _embed("ME", "zero", 5, single),
        "tiled_embed_frames": q["arrow_embed"],
        "tiled_detect_frames": q["arrow_detect"],
        "tiled_stored_signal": _embed("ME", "zero", 3, seven),
        "strided_marked": f"""with m as ({interval}), l as (select stream_id, frame_no, r, string_agg(printf('%02X', v), '' order by c) x from m group by all)
select stream_id, frame_no, string_agg(x || 'FFFFFFFF', '' order by r) padded, string_agg(x, '' order by r) written from l group by stream_id, frame_no""",
        "streamed_numbers": q["frame_numbers"],
        "video_segments": f"""with m as ({interval}), f as (select stream_id, frame_no, string_agg(printf('%02X', v), '' order by r, c) || repeat('80', 32) x from m group by all),
  s as (select stream_id, frame_no // 16 * 16 as first, string_agg(x, '' order by frame_no) x, count(*) * 96 length from f group by all)
select stream_id, printf('%012d.yuv', first) as name, cast(coalesce(sum(length) over (partition by stream_id order by first rows between unbounded preceding and 1 preceding), 0) as bigint) as position, length, sha256(unhex(x)) sha256 from s""",
        "report_run": f"with d as ({q['frame_detect_interval']}) select stream_id * 1000000 + frame img, 'ME' mask, cast(3 as integer) p, 40.0::double psnr, correlation, count(*) over () frames, true timed from d",
    }
    q["streamed_packets"] = q["packet_filter"]
    holes = f"with {IMAGES}, hp as materialized (select * from px where not (r = 3 and c = 3 and img % 5 = 0)), "
    for border in ("zero", "edge"):
        q[f"sparse_neighbours_{border}"] = f"{holes}{near('hp', 'n', 3, border)} select img, r, c, cast(k as integer) k, x from n where k >= 0"
        q[f"coefficients_in_sql_{border}"] = f"with {IMAGES}, {fitted('px', 'p', border)} select img, cast(i as integer) i, round(k, 6) k from pk"
        each = [f"select img, r, c, cast({p} as integer) p, cast(sum(x) as bigint) total, cast(sum(x * x) as bigint) squares from n{p} group by img, r, c" for p in (3, 5, 7, 9)]
        q[f"tiled_moments_{border}"] = f"with {PLANE}, {', '.join(near('px', f'n{p}', p, border) for p in (3, 5, 7, 9))} {' union all '.join(each)}"
    for p, border in ((3, "zero"), (5, "edge"), (9, "zero"), (9, "edge")):
        q[f"tiled_sums_p{p}_{border}"] = _near_sums(p, border)
    q |= {"tiled_gram_p3_edge": _gram("edge"), "tiled_gram_p7": _gram("zero", 7), "tiled_gram_p9": _gram("zero", 9)}
    q |= {"embed_me_p7": _embed("ME", "zero", 7), "embed_me_p9": _embed("ME", "zero", 9), "tiled_embed_nvf_p9_edge": _embed("NVF", "edge", 9)}
    q |= {"window_embed_me": _embed("ME", "zero"), "window_embed_me_edge": _embed("ME", "edge"), "window_embed_nvf": _embed("NVF", "zero"), "window_embed_me_rgb": q["embed_me_rgb"]}
    q |= {"window_detect_me": _detect("ME", "zero"), "window_detect_me_edge": _detect("ME", "edge"), "window_detect_nvf": _detect("NVF", "zero")}
    q |= {"detect_me_p7": _detect("ME", "zero", 7), "detect_me_p9": _detect("ME", "zero", 9)}
    for p, border in ((5, "zero"), (7, "edge"), (9, "zero"), (9, "edge")):
        q[f"neighbour_sums_p{p}_{border}"] = _near_sums(p, border)
    for p in (3, 5, 7, 9):
        q[f"window_moments_p{p}"] = _window(p, "zero")
    for border in ("zero", "edge"):
        q[f"neighbours_p3_{border}"] = _near(3, border)
        q[f"gram_{border}"] = _gram(border)
    return q
