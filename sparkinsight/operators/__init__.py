"""DataFrame -> DataFrame operators (with small ``fit_*`` helpers where a step learns values)."""
