"""SQL text builders for the oracle."""

PI = "pi()"


def hav(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
         f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2))")
    return f"(2*6371008.8e0*asin(sqrt({a})))"


def bearing(lat1, lon1, lat2, lon2):
    b = (f"degrees(atan2(sin(radians(({lon2})-({lon1})))*cos(radians({lat2})), "
         f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))"
         f"*cos(radians(({lon2})-({lon1})))))")
    return f"(CASE WHEN {b} < 0 THEN {b} + 360e0 ELSE {b} END)"


def proj_lat(lat, lon, brg, d):
    return (f"degrees(asin(sin(radians({lat}))*cos(({d})/6371008.8e0)"
            f"+cos(radians({lat}))*sin(({d})/6371008.8e0)*cos(radians({brg}))))")


def proj_lon(lat, lon, brg, d):
    p2 = f"radians({proj_lat(lat, lon, brg, d)})"
    return (f"({lon} + degrees(atan2(sin(radians({brg}))*sin(({d})/6371008.8e0)*cos(radians({lat})), "
            f"cos(({d})/6371008.8e0)-sin(radians({lat}))*sin({p2}))))")


def flat(lat1, lon1, lat2, lon2):
    return (f"sqrt(pow((({lon1})-({lon2}))*111195e0*cos(radians((({lat1})+({lat2}))/2)),2)"
            f"+pow((({lat1})-({lat2}))*111195e0,2))")


def cell(v, size):
    return f"CAST(floor(round(({v})/{size}, 9)) AS BIGINT)"


def area(row, size):
    return f"({size}*111.32e0*cos(radians((({row})+0.5e0)*{size}))*{size}*110.57e0)"


def seg(lon, lat, ax, ay, bx, by):
    kx = f"(111195e0*greatest(cos(radians({lat})),0.01e0))"
    x0, y0 = f"((({ax})-({lon}))*{kx})", f"((({ay})-({lat}))*111195e0)"
    dx, dy = f"((({bx})-({ax}))*{kx})", f"((({by})-({ay}))*111195e0)"
    t = f"(CASE WHEN {dx}*{dx}+{dy}*{dy}=0 THEN 0e0 ELSE greatest(0e0,least(1e0,-({x0}*{dx}+{y0}*{dy})/({dx}*{dx}+{dy}*{dy}))) END)"
    return f"sqrt(pow({x0}+{t}*{dx},2)+pow({y0}+{t}*{dy},2))"


def u(seed, *parts):
    key = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((('0x' || substr(md5({key}),1,8))::BIGINT)/4294967296e0)"


def band(d):
    n = f"(({d})/1852e0)"
    return (f"CASE WHEN {d} IS NULL THEN '> 25 nm' WHEN {n}<1 THEN '0-1 nm' WHEN {n}<2 THEN '1-2 nm' "
            f"WHEN {n}<5 THEN '2-5 nm' WHEN {n}<10 THEN '5-10 nm' WHEN {n}<25 THEN '10-25 nm' ELSE '> 25 nm' END")


def signed(me, other, outer):
    m, o = f"coalesce({me},'inf'::DOUBLE)", f"coalesce({other},'inf'::DOUBLE)"
    sea = f"({o}<=22224e0 OR {o}<{m})" if outer else f"({o}>=22224e0 AND {o}>{m})"
    n = f"((CASE WHEN {sea} THEN {m} ELSE -{m} END)/1852e0)"
    edges = [(-10, '-25 to -10 nm'), (-5, '-10 to -5 nm'), (-2, '-5 to -2 nm'), (-1, '-2 to -1 nm'), (0, '-1 to 0 nm'),
             (1, '0 to 1 nm'), (2, '1 to 2 nm'), (5, '2 to 5 nm'), (10, '5 to 10 nm'), (25, '10 to 25 nm')]
    whens = " ".join(f"WHEN {n}<{hi} THEN '{name}'" for hi, name in edges)
    return f"CASE WHEN {n}<=-25 THEN 'landward > 25 nm' WHEN {n}>=25 THEN 'seaward > 25 nm' {whens} END"


def reception(n, gaps, med):
    return (f"CASE WHEN coalesce({n},0)=0 THEN 'unheard' WHEN {n}<3 OR coalesce({gaps},0)=0 THEN 'thin' "
            f"WHEN {med}<=180 THEN 'heard' ELSE 'intermittent' END")


def wilson(k, n, side):
    k, n = f"CAST({k} AS DOUBLE)", f"nullif(CAST({n} AS DOUBLE),0)"
    p = f"({k}/{n})"
    den = f"(1+3.8416e0/{n})"
    centre = f"(({p}+3.8416e0/(2*{n}))/{den})"
    half = f"(1.96e0*sqrt({p}*(1-{p})/{n}+3.8416e0/(4*{n}*{n}))/{den})"
    return (f"CASE WHEN {n} IS NULL THEN NULL ELSE greatest(0e0,{centre}-{half}) END" if side == "lo"
            else f"CASE WHEN {n} IS NULL THEN NULL ELSE least(1e0,{centre}+{half}) END")


def pieces(src, keep, size):
    """Stretches of the lines (lon0, lat0, lon1, lat1) of ``src`` by lattice cell: keep, col, row, f, g."""
    def edges(a, b):
        lo, hi = cell(f"least({a},{b})", size), cell(f"greatest({a},{b})", size)
        return f"list_filter(list_transform(range({lo}+1, {hi}+1), lambda k: (k*{size}-{a})/({b}-{a})), lambda t: t>0 AND t<1)"
    marks = f"list_sort(list_distinct(list_concat(list_concat([0e0, 1e0], {edges('lon0', 'lon1')}), {edges('lat0', 'lat1')})))"
    return f"""(SELECT {keep}, {cell('lon0+(f+g)/2*(lon1-lon0)', size)} AS col, {cell('lat0+(f+g)/2*(lat1-lat0)', size)} AS row, f, g FROM (
      SELECT *, unnest(m[:len(m)-1]) AS f, unnest(m[2:]) AS g FROM (SELECT *, {marks} AS m FROM {src}))) """


def tail(z):
    """Two-sided normal probability by the fixed polynomial."""
    t = f"(1e0/(1e0+0.2316419e0*abs({z})))"
    poly = "0e0"
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"(({poly}+({c!r}e0))*{t})"
    return f"round(least(1e0, 2e0*{poly}*exp(-({z})*({z})/2e0)/sqrt(2e0*pi())), 9)"
