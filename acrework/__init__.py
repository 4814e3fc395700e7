"""Land-records analytics on Spark: parcels, land-use rules, hearings and text as DataFrame operations."""
