"""zonelens: DNS traffic analytics as Spark DataFrame jobs.

``functions`` holds Column expressions, ``sources`` readers, writers and
dimensions, ``operators`` DataFrame-to-DataFrame steps, ``plans`` the jobs,
registered queries and their SQL twins, ``streaming`` the incremental silver.
"""

__version__ = "0.1.0"
