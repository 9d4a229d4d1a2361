"""Where streams R(r, t_ns, r_ts, x, y) and S(s, t_ns, s_ts, a, b) come from, and measurement files."""
