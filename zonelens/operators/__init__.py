"""DataFrame -> DataFrame operators (silver, features, KPIs, rankings, distributions, reports, packets)."""
