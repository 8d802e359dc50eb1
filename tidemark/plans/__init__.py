"""Plans that run numerical kernels per group: factor models, regimes, probits, nowcasts, walk-forward panels."""
